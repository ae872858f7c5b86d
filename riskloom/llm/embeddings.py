"""Near-duplicate vectors: random-hyperplane sign hashing in several tables,
exact cosine of what shares a bucket, distributed connected components.

Equal vectors are one class from the start, so copies never meet in pairs. The
tables exchange class numbers with a sketch of 128 further signs; only classes
that have a partner in their bucket by the sketch bring their vector there. A
bucket is compared in blocks of bounded size; a block hands on sums and a
spanning forest, never its pairs. A pair that shares several buckets counts in
the first of them alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, in_blocks, shuffle_partitions, split_hot, store, unite
from .components import connected_components

COSINE = 0.95
#: Chance that a pair at the threshold shares no bucket; closer pairs are missed less.
MISS = 1e-5
#: Vectors that a bucket should hold on average, at most.
PER_BUCKET = 256
#: Vectors of one side of a block.
BLOCK = 2048
#: Signs of the sketch, and those that a pair at the threshold differs in at most: 5.5 deviations above the mean.
SKETCH = 128


def shape(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors: bits so that buckets stay small, tables so that pairs at the threshold are found."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / PER_BUCKET))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def most_apart(cosine: float) -> int:
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 5.5 * math.sqrt(SKETCH * p * (1 - p)))


@lru_cache(16)
def planes(dim: int, n: int) -> np.ndarray:
    """n hyperplanes, the same in every task."""
    return np.random.default_rng(dim).standard_normal((dim, n)).astype(np.float32)


def usable(vector: str):
    """Not null, not empty, every component finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def sketched(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """rows (id, vector) with dim, hash of the vector, keys (for each table the signs of
    its hyperplanes as a number, packed) and the sketch; null where the vector is."""

    def make():
        power = 1 << np.arange(bits, dtype=np.int64)

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            vector = batch.column(batch.schema.get_field_index("vector"))
            size = np.array([n or 0 for n in pa.compute.list_value_length(vector).to_pylist()])
            hashes, packed = np.full(len(size), None, object), np.full(len(size), None, object)
            sketch = np.zeros((len(size), SKETCH // 64), np.int64)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                x = _matrix(vector.take(pa.array(at)), d)
                hashes[at] = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x + 0.0]  # -0.0 as 0.0
                x /= np.abs(x).max(1, keepdims=True)  # in double: any finite scale fits the single precision below
                signs = x.astype(np.float32) @ planes(d, bits * tables + SKETCH) >= 0
                keys = (signs[:, : bits * tables].reshape(len(at), tables, bits) @ power).astype("<i4")
                packed[at] = [k.tobytes() for k in keys]
                sketch[at] = np.packbits(signs[:, bits * tables :], axis=1, bitorder="little").view("<i8")
            return [pa.array(size, pa.int32()), pa.array(hashes, pa.binary()), pa.array(packed, pa.binary()), *[pa.array(c) for c in sketch.T]]

        return fn

    fields = [T.StructField("dim", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("keys", T.BinaryType())]
    return append_columns(rows, make, [*fields, *[T.StructField(c, T.LongType()) for c in _SKETCH]])


_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]


def with_partner(sketch: np.ndarray, block: np.ndarray, on_a: np.ndarray, on_b: np.ndarray, most: int) -> np.ndarray:
    """Which rows have another row of the other side of their block within `most` signs."""
    out = np.zeros(len(block), bool)
    edge = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo < 2:
            continue
        a, b = lo + np.flatnonzero(on_a[lo:hi]), lo + np.flatnonzero(on_b[lo:hi])
        for i in range(0, len(a), 256):
            part = a[i : i + 256]
            d = sum(np.bitwise_count(sketch[part, k][:, None] ^ sketch[b, k]).astype(np.uint8) for k in range(sketch.shape[1]))
            x, y = np.nonzero(d <= most)
            far = part[x] != b[y]
            out[part[x[far]]] = out[b[y[far]]] = True
    return out


def compare(rows: dict[str, np.ndarray], block: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Within each block, the links of side a with side b whose first common bucket this is.

    rows: unit (vectors of length 1, one row each), keys, table, copies, on_a, on_b.
    Returns for every row the vectors linked and the smallest row of its linked set in the block.
    """
    parent, links = np.arange(len(block)), np.zeros(len(block), np.int64)
    edge = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
    for lo, hi in zip(edge[:-1], edge[1:]):
        if hi - lo < 2:
            continue
        a, b = lo + np.flatnonzero(rows["on_a"][lo:hi]), lo + np.flatnonzero(rows["on_b"][lo:hi])
        for i in range(0, len(a), 256):
            part = a[i : i + 256]
            x, y = np.nonzero(rows["unit"][part] @ rows["unit"][b].T >= cosine)
            p, q = part[x], b[y]
            # A row on both sides stands in a block with itself: each pair once.
            keep = (p != q) & ~(rows["on_b"][p] & rows["on_a"][q] & (p > q))
            p, q = p[keep], q[keep]
            for s in range(0, len(p), 1 << 16):
                u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                t = rows["table"][lo]
                if t:
                    new = ~(rows["keys"][u, :t] == rows["keys"][v, :t]).any(1)
                    u, v = u[new], v[new]
                np.add.at(links, u, rows["copies"][v])
                np.add.at(links, v, rows["copies"][u])
                unite(parent, u, v)
    return links, parent


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row of vectors.

    n_links counts the other rows with a cosine of at least `cosine` that were
    found; component_id is the smallest key reachable by links; kept where the
    key is its component's. Null, empty and zero vectors and those with a null or
    non-finite component have no links. Vectors of different lengths never link;
    equal vectors always do. A null key is a row without links. Rows that repeat
    a key count as further vectors with it.
    """
    kind = vectors.schema[vector].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    rows = vectors.select(F.col(key).cast("long").alias("id"), (F.col(vector) if exact else F.transform(vector, lambda x: x.cast("double"))).alias("vector"))
    rows = rows.select("id", F.when(usable("vector") & F.col("id").isNotNull(), F.col("vector")).alias("vector"))
    bits, tables = shape(vectors.count(), cosine)
    keyed = store(sketched(rows, bits, tables).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Equal vectors are a class, named by the number of one of its rows; the numbers stand in the written table.
    alike = [F.first(c).alias(c) for c in ("dim", "keys", *_SKETCH)]
    classes = keyed.df.where("hash is not null").groupBy("hash").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), *alike)
    classes = store(classes, "vector-classes")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(b.schema.get_field_index("keys")).to_pylist()), "<i4")
            row = pa.array(np.repeat(np.arange(b.num_rows), tables))
            own = [b.column(b.schema.get_field_index(c)).take(row) for c in ("dim", "node", *_SKETCH)]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), pa.array(keys), *own[1:]], ["dim", "table", "bucket", "node", *_SKETCH])

    found = classes.df.select("dim", "keys", "node", *_SKETCH).mapInArrow(explode, "dim int, table int, bucket int, node long, " + ", ".join(f"{c} long" for c in _SKETCH))
    order = ["dim", "table", "bucket", "part_a", "part_b"]
    place = [*order, "on_a", "on_b", "node"]
    in_order = lambda df: df.repartition(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order, "node")
    most = most_apart(cosine)

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, block in in_blocks(batches, order, 4 * BLOCK):
            sketch = np.stack([rows_.column(c).to_numpy() for c in _SKETCH], 1).view(np.uint64)
            wanted = with_partner(sketch, block, rows_.column("on_a").to_numpy(), rows_.column("on_b").to_numpy(), most)
            if wanted.any():
                yield from rows_.select(place).filter(pa.array(wanted)).combine_chunks().to_batches()

    dealt = in_order(split_hot(found, ["dim", "table", "bucket"], "node", BLOCK))
    open_ = store(dealt.mapInArrow(partnered, T.StructType([dealt.schema[c] for c in place])), "vector-open")
    # A vector with a partner moves once to its row of this table, then to its buckets.
    needed = open_.df.select("node").distinct()
    full = keyed.df.select(F.col("row").alias("node"), "vector", "keys").join(needed, "node").join(classes.df.select("node", "copies"), "node")
    full = store(full, "vector-needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, block in in_blocks(batches, order, BLOCK):
            size = rows_.column("dim").to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                own = rows_.take(pa.array(at))
                x = _matrix(own.column("vector"), int(d))
                x /= np.abs(x).max(1, keepdims=True)
                keys = np.frombuffer(b"".join(own.column("keys").to_pylist()), "<i4").reshape(len(at), tables)
                own_rows = {"unit": x / np.linalg.norm(x, axis=1, keepdims=True), "keys": keys}
                own_rows |= {c: own.column(c).to_numpy() for c in ("table", "copies", "on_a", "on_b")}
                links, parent = compare(own_rows, block[at], cosine)
                node, hit = own.column("node").to_numpy(), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[parent[hit]])], ["node", "links", "root"])

    linked = store(in_order(open_.df.join(full.df, "node")).mapInArrow(run, "node long, links long, root long"), "vector-links")
    totals = linked.df.groupBy("node").agg(F.sum("links").alias("links"))
    member = connected_components(linked.df.where("node <> root"), "node", "root")
    named = classes.df.select("hash", "node", "least", "copies").join(totals, "node", "left").join(member, "node", "left")
    first = named.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(first, "component", "left").select("hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    out = keyed.df.select("id", "hash").join(named, "hash", "left")
    component = F.coalesce("component_id", "id")
    done = store(out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")), "vector-result")
    for used in (keyed, classes, open_, full, linked):
        used.drop()
    return done.df


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op2_embedding_near_dedup."""
    from .common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach(id, c) as (
  select vec_id, vec_id from embeddings union select l.b, r.c from reach r join links l on l.a = r.id
), component as (select id, min(c) as c from reach group by id), n as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, e.vec_id = c.c as kept
from embeddings e join component c on e.vec_id = c.id left join n on n.a = e.vec_id
"""
