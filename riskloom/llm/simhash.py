"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a
Hamming radius by BK-trees whose children are keyed by the distance to the parent.

All pairs within the radius share some bands of bits (pigeonhole), so prints are
sharded by every choice of bands; each shard of bounded size has its tree, which
goes to the blocks of queries of that shard alone, and searches follow only edges
within the radius. Nothing is collected, and a block hands on a spanning forest
of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, in_blocks, shuffle_partitions, split_hot, store, texts, unite
from .components import connected_components

#: Prints of one side of a block, and so nodes of one tree.
SHARD = 4096
#: Prints that a choice of bands should leave in a shard on average, at most.
PER_SHARD = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words, repeats included; of all words if they are fewer; none without words."""
    words = text.translate(_LOWER).split()  # bytes.split() cuts at 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.array([len(w) for w in words]).cumsum() + np.arange(len(words))
    starts = np.r_[0, ends[:-1] + 1]
    f = xxhash.xxh64_intdigest
    return np.array([f(line[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fp): the fingerprint of each text as a signed long. Null and wordless texts have 0."""

    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [majority(shingle_hashes(t, size)) for t in texts(batch, text)]
            return [pa.array(np.array(found, np.uint64).view(np.int64))]

        return fn

    return append_columns(docs.select(key, text), make, [T.StructField("fp", T.LongType())], [key])


def bands_for(n: int, radius: int) -> list[tuple[int, ...]]:
    """Masks of bit positions: any two prints within the radius agree under one of them.

    The 64 bits are cut into m > radius bands; m - radius of them must agree.
    m grows with the number of prints, so that a shard stays small on average.
    """
    m = radius + 1
    while m < 2 * radius and n / 2 ** (64 * (m - radius) // m) > PER_SHARD:
        m += 1
    edges = np.linspace(0, 64, m + 1).round().astype(int)
    return [tuple(b for i in chosen for b in range(edges[i], edges[i + 1])) for chosen in combinations(range(m), m - radius)]


class Forest:
    """BK-trees of several shards at once, in arrays: node i is print i; the child
    of a node at distance d is found by the key node * span + d. A print is one
    word of 64 bits, or a row of several."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        """shard: a number for each print, consecutive from 0, in ascending order."""
        self.prints = prints
        self.bits = 64 if prints.ndim == 1 else 64 * prints.shape[1]
        self.span = self.bits + 1
        n = len(prints)
        self.root = np.searchsorted(shard, np.arange(shard[-1] + 1 if n else 0))
        at = self.root[shard] if n else np.empty(0, np.int64)
        left = np.flatnonzero(at != np.arange(n))
        keys, kids = [], []
        while len(left):
            key = at[left] * self.span + apart(prints[left], prints[at[left]])
            first, where = np.unique(key, return_index=True)
            keys.append(first)
            kids.append(left[where])
            at[left] = left[where][np.searchsorted(first, key)]
            left = left[at[left] != left]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.kids = self.keys[order], self.kids[order]

    def within(self, asked: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of prints within the radius, level by level of the trees."""
        query, node = np.arange(len(asked)), self.root[shard]
        while len(query):
            d = apart(asked[query], self.prints[node])
            near = d <= radius
            yield query[near], node[near], d[near]
            low = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.bits), "right")
            size = high - low
            query = np.repeat(query, size)
            ends = np.cumsum(size)
            node = self.kids[np.arange(ends[-1]) + np.repeat(low - (ends - size), size)] if len(size) else node[:0]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of prints of one word, or of rows of several."""
    d = np.bitwise_count(a ^ b)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(1, dtype=np.int64)


def forest_links(fp: np.ndarray, node: np.ndarray, block: np.ndarray, on_a: np.ndarray, on_b: np.ndarray, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) of a spanning forest of the links in each block. block: ascending numbers."""
    a, b = np.flatnonzero(on_a), np.flatnonzero(on_b)
    both, number = np.unique(block[a], return_inverse=True)
    prints = fp.view(np.uint64)
    tree = Forest(prints[a], number)
    b = b[np.isin(block[b], both)]
    of_b = np.searchsorted(both, block[b])
    parent = np.arange(len(fp))
    for i in range(0, len(b), step):
        q = b[i : i + step]
        for query, hit, _ in tree.within(prints[q], of_b[i : i + step], radius):
            unite(parent, q[query], a[hit])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return node[moved], node[parent[moved]]


def link_prints(prints: DataFrame, radius: int) -> DataFrame:
    """prints: (fp, node), fp distinct. Edges (a, b) between nodes whose components are those of the links within the radius."""
    n = prints.count()
    masks = bands_for(n, radius)
    choices = []
    for i, bits in enumerate(masks):
        mask = sum(1 << b for b in bits)
        choices.append(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
    rows = prints.select("fp", "node", F.explode(F.array(*choices)).alias("s")).select("s.band", "s.value", "fp", "node")
    blocks = split_hot(rows, ["band", "value"], "fp", SHARD)
    keys = ["band", "value", "part_a", "part_b"]
    dealt = blocks.repartition(shuffle_partitions(prints.sparkSession), *keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in in_blocks(batches, keys, 4 * SHARD):
            get = lambda c: rows.column(c).to_numpy()
            a, b = forest_links(get("fp"), get("node"), block, get("on_a"), get("on_b"), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component_id): one row per row of docs; component_id is the smallest key reachable by links.

    Fingerprints within `radius` differing bits link. Equal prints are one node,
    the smallest of their keys, so copies never meet in pairs. A null key is kept
    and gets the component of its print. A print without neighbours is its own
    component. No rows give no rows.
    """
    found = store(fingerprints(docs, key, text, size), "simhash")
    prints = store(found.df.groupBy("fp").agg(F.min(key).alias("node")).where("node is not null"), "simhash-prints")
    member = connected_components(link_prints(prints.df, radius))
    named = prints.df.join(member, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.df.join(named, "fp", "left").select(key, "fp", "component_id")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op5_simhash_near_dedup."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
