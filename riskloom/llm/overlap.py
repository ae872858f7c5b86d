"""Near-duplicate texts by the overlap of their word shingles, found with SimHash.

A set of shingles is hashed to signs of random hyperplanes. The first 128 are its
fingerprint; the others are cut into tables of short keys that shard the
fingerprints, so that a pair at the threshold shares a shard almost surely. In a
shard, BK-trees give the prints within the radius, and the exact Jaccard overlap
of the two sets (of 32-bit hashes) decides.

Links matter only for groups, so two rounds suffice. First each set is held
against the nearest candidate of all its shards, one row a set, which joins
copies to their groups. Then shards are searched for candidates that still lie
in different groups; where there are any, the sets of those rows come to the
shard and are decided there. No round hands on pairs: the first a candidate a
set, the second a spanning forest a shard, so rows stay in proportion to sets
times tables whatever the size of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, append_columns, deal_apart, in_blocks, mix64, shuffle_partitions, split_parts, store, texts
from .components import connected_components
from .simhash import Forest, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
#: Dimensions of the hashed vector whose Hadamard transform gives the signs, and
#: the weights of a shingle in its dimensions: unequal, so that no sum is zero.
WIDTH, WEIGHTS = 4096, (1.0, 0.91, 0.83, 0.76)
#: Words of 64 signs in a fingerprint.
WORDS = 2
#: Signs kept of a set, at least.
LEAST_BITS = 512
#: Chance that a pair at the threshold shares no shard.
MISS = 0.01
#: Texts that a shard should hold on average, at most, and rows of one side of a block.
PER_SHARD, SHARD = 256, 1024


def differing(similarity: float) -> float:
    """Share of signs in which sets of that Jaccard overlap differ; sets of like size, which differ most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape(n: int, similarity: float) -> tuple[int, int]:
    """(bits, tables) of the shards for n texts."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / PER_SHARD))))
    same = (1 - differing(similarity)) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def most_bits(n_bits: int, similarity: float) -> int:
    """Signs of n_bits in which a pair at the threshold differs at most, but for a chance of about one in a thousand."""
    p = differing(similarity)
    return math.ceil(n_bits * p + 3.1 * math.sqrt(n_bits * p * (1 - p)))


def signs(sets: list[np.ndarray], n_bits: int) -> np.ndarray:
    """(texts, n_bits) booleans: signs of a randomised Hadamard transform of the hashed sets."""
    out = np.empty((len(sets), -(-n_bits // WIDTH) * WIDTH), bool)
    v = np.zeros((len(sets), WIDTH), np.float32)
    for row, s in enumerate(sets):
        h = mix64(s.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        own = np.ascontiguousarray(h).view("<u2").astype(np.int64)  # 16 bits for each weight
        v[row] = np.bincount(own % WIDTH, ((own >> 12) % 2 * 2.0 - 1) * np.tile(WEIGHTS, len(s)), WIDTH)
    for part in range(out.shape[1] // WIDTH):
        x = v * np.random.default_rng(part + 1).choice(np.array([-1, 1], np.float32), WIDTH)
        step = 1
        while step < WIDTH:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), WIDTH)
            step *= 2
        out[:, part * WIDTH : (part + 1) * WIDTH] = x >= 0
    return out[:, :n_bits]


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles of a text."""
    return np.unique((shingle_hashes(text, size) >> np.uint64(32)).astype(np.uint32))


def sketches(docs: DataFrame, key: str, text: str, size: int, n_bits: int) -> DataFrame:
    """(id, th, whole, sig, shingles): hash of the text, hash of the set, its signs packed,
    its members as sorted 32-bit numbers; the last three null for a text without words."""

    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            own = texts(batch, "text")
            sig, members = [], []
            for i in range(0, len(own), 64):
                sets = [shingle_set(t, size) for t in own[i : i + 64]]
                packed = np.packbits(signs(sets, n_bits), axis=1, bitorder="little")
                sig += [p.tobytes() if len(s) else None for s, p in zip(sets, packed)]
                members += [s.tobytes() if len(s) else None for s in sets]
            return [pa.array(sig, pa.binary()), pa.array(members, pa.binary())]

        return fn

    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    made = append_columns(rows, make, [T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.BinaryType())], ["id", "th"])
    return made.withColumn("whole", F.unhex(F.substring(F.sha2("shingles", 256), 1, 32)))


_PRINT = [f"p{i}" for i in range(WORDS)]


def _sharded(nodes: DataFrame, bits: int, tables: int, extra: list[str]) -> DataFrame:
    """A row for each node and table: (band, value, p0, p1, node, ...)."""
    keep = ["node", *extra]
    longs = [T.StructField(c, T.LongType()) for c in ("value", *_PRINT)]
    schema = T.StructType([T.StructField("band", T.IntegerType()), *longs, *[nodes.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sig = np.frombuffer(b"".join(part.column(part.schema.get_field_index("sig")).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                fp = np.ascontiguousarray(sig[:, : 8 * WORDS]).view("<i8")
                one = np.unpackbits(sig[:, 8 * WORDS :], axis=1, bitorder="little")[:, : bits * tables]
                value = one.reshape(-1, tables, bits) @ power
                row = np.repeat(np.arange(part.num_rows), tables)
                columns = [pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(value.ravel())]
                columns += [pa.array(fp[row, i]) for i in range(WORDS)]
                columns += [part.column(part.schema.get_field_index(c)).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return nodes.select("sig", *keep).mapInArrow(run, schema)


def _hits(rows: pa.Table, block: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of prints of one block within the radius."""
    a, b = np.flatnonzero(rows.column("on_a").to_numpy()), np.flatnonzero(rows.column("on_b").to_numpy())
    both, number = np.unique(block[a], return_inverse=True)
    prints = np.stack([rows.column(c).to_numpy() for c in _PRINT], 1).view(np.uint64)
    tree = Forest(prints[a], number)
    b = b[np.isin(block[b], both)]
    of_b = np.searchsorted(both, block[b])
    for i in range(0, len(b), 512):
        q = b[i : i + 512]
        for query, hit, d in tree.within(prints[q], of_b[i : i + 512], radius):
            x, y = q[query], a[hit]
            new = x != y
            yield x[new], y[new], d[new]


_BLOCK = ["band", "value", "part_a", "part_b"]
_FAR = np.iinfo(np.int64).max


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), *_BLOCK).sortWithinPartitions(*_BLOCK, "node")


def _nearest(radius: int):
    """(node, lo, rank) of each node that may have a candidate in the block: the nearest of smaller
    number, of equally near ones any by hash (so that no set becomes the partner of all), or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in in_blocks(batches, _BLOCK, 16 * SHARD):
            node = rows.column("node").to_numpy()
            best, other = np.full(len(node), _FAR), np.full(len(node), -1)
            # Of a shard that was cut in parts this block sees one: all its rows may have candidates.
            seen = rows.column("cut").to_numpy(zero_copy_only=False).copy()
            for x, y, d in _hits(rows, block, radius):
                seen[x] = seen[y] = True
                up = node[x] > node[y]
                hi, lo = np.where(up, x, y), np.where(up, y, x)
                rank = (d << 54) | (mix64(mix64(node[lo].view(np.uint64)) ^ node[hi].view(np.uint64)) >> np.uint64(10)).astype(np.int64)
                np.minimum.at(best, hi, rank)
                won = best[hi] == rank
                other[hi[won]] = lo[won]
            at = np.flatnonzero(seen)
            none = best[at] == _FAR
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[other[at]], mask=none), pa.array(best[at])], ["node", "lo", "rank"])

    return run


def _apart(radius: int):
    """Rows of a block that have a candidate of another component in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in in_blocks(batches, _BLOCK, 16 * SHARD):
            group = rows.column("component").to_numpy()
            wanted = np.zeros(len(group), bool)
            if len(group) > 1 and (group != group[0]).any():
                for x, y, _ in _hits(rows, block, radius):
                    far = group[x] != group[y]
                    wanted[x[far]] = wanted[y[far]] = True
            if wanted.any():
                yield from rows.filter(pa.array(wanted)).combine_chunks().to_batches()

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _decided(radius: int, most: int, similarity: float):
    """Spanning forest of the links of different components in each block, by the sets of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in in_blocks(batches, _BLOCK, 1):
            node, group = rows.column("node").to_numpy(), rows.column("component").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
            sets = [np.frombuffer(s, np.uint32) for s in rows.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            up = {g: g for g in group.tolist()}

            def top(g: int) -> int:
                while up[g] != g:
                    up[g] = up[up[g]]
                    g = up[g]
                return g

            found: list[tuple[int, int]] = []
            for x, y, _ in _hits(rows, block, radius):
                far = (group[x] != group[y]) & (np.maximum(size[x], size[y]) * similarity <= np.minimum(size[x], size[y]))
                x, y = x[far], y[far]
                for i in range(0, len(x), 1 << 16):
                    p, q = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
                    d = np.bitwise_count(sig[p] ^ sig[q]).sum(1, dtype=np.int64)
                    near = np.flatnonzero(d <= most)
                    for k in near[np.argsort(d[near], kind="stable")].tolist():
                        a, b = top(int(group[p[k]])), top(int(group[q[k]]))
                        if a != b and jaccard(sets[p[k]], sets[q[k]]) >= similarity:
                            up[max(a, b)] = min(a, b)
                            found.append((int(node[p[k]]), int(node[q[k]])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["hi", "lo"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32)
                ok.append(max(len(x), len(y)) * similarity <= min(len(x), len(y)) and jaccard(x, y) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["hi", "lo"])

    one = sets.select(F.col("node").alias("hi"), F.col("shingles").alias("s"))
    two = sets.select(F.col("node").alias("lo"), F.col("shingles").alias("t"))
    return pairs.join(one, "hi").join(two, "lo").select("hi", "lo", "s", "t").mapInArrow(run, "hi long, lo long")


def _grouped(docs: DataFrame, key: str, text: str, size: int, similarity: float) -> Stored:
    """(id, th, head): for each row with a key and words, the smallest (id, hash of text) of its group."""
    bits, tables = shape(docs.count(), similarity)
    n_bits = max(LEAST_BITS, 64 * WORDS + bits * tables)
    radius = most_bits(64 * WORDS, similarity)
    rows = sketches(docs.where(F.col(key).isNotNull()), key, text, size, n_bits).where("whole is not null")
    made = store(rows.withColumn("row", F.monotonically_increasing_id()), "overlap")
    # A set is a node, named by the number of one of its rows; the numbers stand in the written table.
    equal = made.df.groupBy("whole").agg(F.min("row").alias("node"), F.min(F.struct("id", "th")).alias("head"), F.first("sig").alias("sig"))
    nodes = store(equal, "overlap-nodes")
    parts = split_parts(_sharded(nodes.df, bits, tables, []), ["band", "value"], "node", SHARD)
    nearest = _in_order(parts).mapInArrow(_nearest(radius), "node long, lo long, rank long")
    near = store(nearest.groupBy("node").agg(F.min_by("lo", "rank").alias("lo")), "overlap-near")
    # The members of sets that may have a candidate move once; the others never do.
    sets = store(made.df.select(F.col("row").alias("node"), "sig", "shingles").join(near.df.select("node"), "node"), "overlap-sets")
    ids = store(made.df.select("id", "th", "whole"), "overlap-ids")
    made.drop()
    first = store(_verified(near.df.where("lo is not null").select(F.col("node").alias("hi"), "lo"), sets.df, similarity), "overlap-links")
    member = connected_components(first.df, "hi", "lo")
    labelled = sets.df.select("node", "sig").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    between = _in_order(deal_apart(_sharded(labelled, bits, tables, ["component"]), ["band", "value"], "component", "node", SHARD))
    open_ = store(between.mapInArrow(_apart(radius), between.schema), "overlap-open")
    full = open_.df.join(sets.df, "node")
    more = store(_in_order(full).mapInArrow(_decided(radius, most_bits(n_bits, similarity), similarity), "hi long, lo long"), "overlap-more")
    member = connected_components(first.df.unionByName(more.df), "hi", "lo")
    heads = nodes.df.select("node", "whole", "head").join(member, "node", "left")
    least = heads.where("component is not null").groupBy("component").agg(F.min("head").alias("least"))
    named = heads.join(least, "component", "left").select("whole", F.coalesce("least", "head").alias("head"))
    out = store(ids.df.join(named, "whole").select("id", "th", "head"), "overlap-groups")
    for done in (ids, nodes, near, sets, first, open_, more):
        done.drop()
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component), one row for each row of docs with a key and words; component
    is the smallest key of the group.

    Texts whose sets of `size`-word shingles (lower-cased, words between white
    space; the whole text if it has fewer words) overlap by `similarity` or more
    (Jaccard) link. Equal sets are one node from the start. Rows with a null key
    or without words (null and empty texts) are left out. Rows that repeat a key
    are judged each by its own text. No rows give no rows.
    """
    return _grouped(docs, key, text, size, similarity).df.select("id", F.col("head.id").alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group, that of the smallest key; columns unchanged.

    Rows with a null key or without words stay. Rows that repeat a key stand each
    for its own text; of rows that repeat both, one stays.
    """
    found = _grouped(docs, key, text, size, similarity).df
    is_head = (F.col("id") == F.col("head.id")) & (F.col("th") == F.col("head.th"))
    gone = found.where(~is_head).select("id", "th").distinct()
    twice = found.where(is_head).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "th")
    same = lambda to: (docs[key].cast("long") == to["id"]) & (F.xxhash64(docs[text]) == to["th"])
    left = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, same(twice), "left_anti").unionByName(left.join(twice, same(twice), "left_semi").dropDuplicates([key, text]))
