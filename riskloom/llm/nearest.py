"""Approximate nearest neighbours by largest inner product: Gaussian (2-stable)
projections to few dimensions under a kd-tree; a query takes its projected
neighbours in order and verifies them until a chi-square test says that a nearer
one would have been seen.

Vectors become points of a sphere (a further component fills their length up to
the greatest), where the largest inner product is the least distance. The top of
the kd-tree, fitted on a bounded sample, deals all points into shards; a query
visits the shard it falls into, then with the distance found there only the shards
whose box the test can't rule out. Each shard has the rest of the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, bound_batches, shuffle_partitions, store
from .embeddings import usable

TOP, EVERY = 20, 20
#: Dimensions of the projection (even), and the chance that a nearer point would have been seen when a query stops.
AXES, CHANCE = 10, 0.99
#: Points of a shard, of a leaf of its tree, queries searched at a time, and queries that one copy of a shard serves.
SHARD, LEAF, TOGETHER, SERVED = 8192, 128, 512, 100_000
#: Projected points that the top of the tree is fitted on, at most, and those behind a shard at least.
SAMPLE, BEHIND = 100_000, 8


@lru_cache(8)
def stretch(axes: int = AXES, chance: float = CHANCE) -> float:
    """Quantile of the chi-square distribution: a point at distance 1 has a squared projected distance below it with this chance."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(axes // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < chance else (low, middle)
    return high


@lru_cache(16)
def directions(dim: int) -> np.ndarray:
    """The projection of dim components and the one that fills up, the same in every task."""
    return np.random.default_rng(dim + 1).standard_normal((dim + 1, AXES))


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1)
    return most * np.sqrt(np.square(x / most[:, None]).sum(1))


def on_sphere(x: np.ndarray, greatest: float) -> np.ndarray:
    """Projected points: x over the greatest length, filled up to length 1."""
    unit = x / greatest
    fill = np.sqrt(np.maximum(0, 1 - np.square(unit).sum(1)))
    return np.c_[unit, fill] @ directions(x.shape[1])


def asked_from(x: np.ndarray) -> np.ndarray:
    """Projected queries: of length 1 without fill. Scaling a query leaves its order."""
    return np.c_[x / lengths(x)[:, None], np.zeros(len(x))] @ directions(x.shape[1])


class Splits:
    """The top of the tree: for each vector length a list of inner nodes (axis, value, left, right); below 0 a shard."""

    def __init__(self, sample: dict[int, np.ndarray], points: dict[int, int], shard: int):
        self.nodes: dict[int, list] = {}
        self.root: dict[int, int] = {}
        self.shards = 0
        for dim, n in points.items():
            self.nodes[dim] = []
            self.root[dim] = self._grow(dim, sample.get(dim, np.zeros((0, AXES))), -(-n // shard))

    def _grow(self, dim: int, at: np.ndarray, parts: int) -> int:
        spread = at.max(0) - at.min(0) if len(at) else np.zeros(AXES)
        if parts <= 1 or len(at) < 2 * BEHIND or not spread.max() > 0:
            self.shards += 1
            return -self.shards
        axis = int(np.argmax(at.var(0)))
        value = float(np.quantile(at[:, axis], (parts // 2) / parts))
        left = at[:, axis] < value
        if not left.any() or left.all():
            value = float(at[:, axis].mean())
            left = at[:, axis] < value
        here = len(self.nodes[dim])
        self.nodes[dim].append(None)
        a = self._grow(dim, at[left], parts // 2)
        b = self._grow(dim, at[~left], parts - parts // 2)
        self.nodes[dim][here] = (axis, value, a, b)
        return here

    def shard_of(self, dim: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        todo = [(self.root[dim], np.arange(len(at)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, value, a, b = self.nodes[dim][node]
            left = at[rows, axis] < value
            todo += [(a, rows[left]), (b, rows[~left])]
        return out


def outside(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    gap = np.zeros((len(at), len(low)))
    for k in range(low.shape[1]):
        z = at[:, k, None]
        gap += np.square(np.maximum(np.maximum(low[:, k] - z, z - high[:, k]), 0))
    return gap


class Tree:
    """A kd-tree over the projected points of a shard: leaves in order, with their boxes."""

    def __init__(self, at: np.ndarray):
        self.order = np.arange(len(at))
        self.begin = [0]
        self._cut(at, 0, len(at))
        self.begin = np.array(self.begin)
        self.low = np.minimum.reduceat(at[self.order], self.begin[:-1])
        self.high = np.maximum.reduceat(at[self.order], self.begin[:-1])

    def _cut(self, at: np.ndarray, a: int, b: int) -> None:
        if b - a <= LEAF:
            self.begin.append(b)
            return
        own = self.order[a:b]
        middle = (b - a) // 2
        self.order[a:b] = own[np.argpartition(at[own][:, int(np.argmax(np.ptp(at[own], 0)))], middle)]
        self._cut(at, a, a + middle)
        self._cut(at, a + middle, b)


def search(tree: Tree, points: np.ndarray, first: np.ndarray, greatest: float, queries: np.ndarray, at: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, scores) of the k best for each query, -1 where there are fewer; equal scores by `first`.

    Leaves come by projected distance. A query stops at a leaf further than its k-th best
    distance (at most reach, squared) times the stretch of the projection.
    """
    box = outside(tree.low, tree.high, at)
    turn = np.argsort(box, 1)
    scale = lengths(queries) * greatest
    best, who = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    active = np.arange(len(queries))
    for j in range(len(tree.low)):
        leaf = turn[active, j]
        kth = np.minimum(reach[active], 2 - 2 * best[active, -1] / scale[active])
        on = ~(box[active, leaf] >= stretch() * kth)
        active, leaf = active[on], leaf[on]
        if not len(active):
            break
        score, found = np.full((len(active), LEAF), -np.inf), np.full((len(active), LEAF), -1)
        for one in np.unique(leaf).tolist():
            q = np.flatnonzero(leaf == one)
            own = tree.order[tree.begin[one] : tree.begin[one + 1]]
            score[q, : len(own)] = queries[active[q]] @ points[own].T
            found[q, : len(own)] = own
        score, found = np.c_[best[active], score], np.c_[who[active], found]
        kept = np.argsort(-score, 1, kind="stable")[:, :k]
        best[active], who[active] = np.take_along_axis(score, kept, 1), np.take_along_axis(found, kept, 1)
    # The very measure on the vectors as they came, summed alike wherever a pair meets.
    exact = np.where(who >= 0, np.einsum("qkd,qd->qk", points[who], queries, optimize=False), -np.inf)
    order = np.lexsort((first[who], -exact), axis=1)
    return np.take_along_axis(who, order, 1), np.take_along_axis(exact, order, 1)


def classes_of(vectors: DataFrame, key: str, vector: str, every: int, keep: int) -> DataFrame:
    """(a, b, dim, vector, ids, asked) of each set of equal vectors: its `keep` smallest keys, and whether one is a query's."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector")).where("id is not null")
    rows = rows.where(usable("vector")).select("id", "vector", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(7), "vector").alias("b"))
    asked = rows.where(F.col("id") % every == 0).select("a", "b").distinct().withColumn("asked", F.lit(True))
    # Spark limits the window's rows in each task before they are exchanged.
    small = rows.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("r") <= keep)
    alike = small.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    return alike.join(asked, ["a", "b"], "left").select("a", "b", F.size("vector").alias("dim"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every` the `top`
    other rows of largest inner product that were found, nearest first, ties to the smaller key.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows
    without a key, take no part. Vectors meet those of their own length. Rows that repeat a
    key are vectors, and queries, of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    keep = top + 1
    classes = store(classes_of(vectors, key, vector, every, keep).withColumn("node", F.monotonically_increasing_id()), "nearest-classes")
    # One row a vector length.
    most = {r.dim: (r.n, r.most) for r in _lengths(classes.df).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()}
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    greatest = {d: m for d, (_, m) in most.items()}
    splits = Splits(_sample(classes.df, greatest), {d: n for d, (n, _) in most.items()}, SHARD)
    points = store(_dealt(classes.df, greatest, splits), "nearest-points")
    extent = [f(F.col("at")[k]).alias(f"{n}{k}") for k in range(AXES) for n, f in (("low", F.min), ("high", F.max))]
    # One row a shard: the sample bounds their number.
    boxes = points.df.groupBy("shard", "dim").agg(F.count(F.lit(1)).alias("n"), *extent).orderBy("shard").collect()
    visits = points.df.where("asked").select("node", F.col("home").alias("shard"), F.lit(4.0).alias("reach"))
    found = store(_search(spark, points.df, visits, boxes, greatest, keep), "nearest-home")
    reach = found.df.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).select("node", F.when(F.col("n") >= keep, F.col("d")).otherwise(4.0).alias("reach"))
    further = _search(spark, points.df, _further(points.df.where("asked").join(reach, "node", "left"), boxes), boxes, greatest, keep)
    both = found.df.unionByName(further)
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), "first")
    best = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).select("node", "score", F.col("other"))
    ids = classes.df.select(F.col("node").alias("other"), "ids")
    listed = best.join(ids, "other").groupBy("node").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids", (F.col("node") == F.col("other")).alias("own"))).alias("sets"))
    pairs = F.expr("flatten(transform(sets, s -> transform(s.ids, i -> struct(s.s as s, i as id, s.own as own))))")
    listed = listed.select("node", F.slice(F.sort_array(pairs), 1, keep).alias("list")).join(classes.df.select("node", "a", "b"), "node").select("a", "b", "list")
    asked = vectors.select(F.col(key).cast("long").alias("query_id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("query_id") % every == 0)
    asked = asked.where(usable("v")).select("query_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"))
    joined = asked.join(listed, ["a", "b"])
    own = F.expr("array_position(transform(list, x -> x.own and x.id = query_id), true)")
    others = F.slice(F.filter("list", lambda x, i: i != F.col("own") - 1), 1, top)
    out = store(joined.withColumn("own", own).select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")), "nearest")
    for used in (classes, points, found):
        used.drop()
    return out.df


def _lengths(classes: DataFrame) -> DataFrame:
    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            out = np.zeros(batch.num_rows)
            for _, at, x in _by_length(batch):
                out[at] = lengths(x)
            return [pa.array(out)]

        return fn

    return append_columns(classes.select("dim", "vector"), make, [T.StructField("norm", T.DoubleType())], ["dim"])


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector length, rows, their vectors as a matrix)."""
    dims, vector = batch.column("dim").to_numpy(), batch.column("vector")
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        own = vector.take(pa.array(at))
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        yield d, at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sample(classes: DataFrame, greatest: dict[int, float]) -> dict[int, np.ndarray]:
    """Projected points of at most SAMPLE classes, those of least hash."""
    drawn = classes.orderBy("a", "b").limit(SAMPLE).select("dim", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, x in _by_length(b):
                at = on_sphere(x, greatest[d])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(list(at.astype(np.float32)))], ["dim", "at"])

    rows = drawn.mapInArrow(run, "dim int, at array<float>").toPandas()
    return {d: np.array(part["at"].tolist(), np.float64) for d, part in rows.groupby("dim")}


def _dealt(classes: DataFrame, greatest: dict[int, float], splits: Splits) -> DataFrame:
    """Points with their shard and projection; those asked for with the shard they fall into as queries, and their projection as such."""
    top = classes.sparkSession.sparkContext.broadcast(splits)

    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            n = batch.num_rows
            shard, home = np.zeros(n, np.int32), np.zeros(n, np.int32)
            at, query = np.zeros((n, AXES)), np.zeros((n, AXES))
            for d, rows, x in _by_length(batch):
                at[rows], query[rows] = on_sphere(x, greatest[d]), asked_from(x)
                shard[rows], home[rows] = top.value.shard_of(d, at[rows]), top.value.shard_of(d, query[rows])
            return [pa.array(shard), pa.array(home), pa.array(list(at)), pa.array(list(query))]

        return fn

    rows = classes.select("node", "dim", "vector", F.col("ids")[0].alias("first"), "asked")
    several = T.ArrayType(T.DoubleType())
    return append_columns(rows, make, [T.StructField("shard", T.IntegerType()), T.StructField("home", T.IntegerType()), T.StructField("at", several), T.StructField("query", several)])


def _further(asked: DataFrame, boxes: list) -> DataFrame:
    """(node, shard, reach): the shards beside its own that the test can't rule out for a query."""
    shards, dims = np.array([b.shard for b in boxes]), np.array([b.dim for b in boxes])
    low, high = (np.array([[b[f"{n}{k}"] for k in range(AXES)] for b in boxes]) for n in ("low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, home, dim = (b.column(c).to_numpy() for c in ("node", "home", "dim"))
            reach = b.column("reach").to_numpy(zero_copy_only=False)
            at = np.array(b.column("query").to_pylist()).reshape(-1, AXES)
            for s in range(0, len(node), 256):
                part = slice(s, s + 256)
                open_ = (outside(low, high, at[part]) < stretch() * np.where(np.isnan(reach[part]), 4.0, reach[part])[:, None]) & (dims == dim[part, None]) & (shards != home[part, None])
                q, x = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(node[part][q]), pa.array(shards[x].astype(np.int32)), pa.array(reach[part][q])], ["node", "shard", "reach"])

    rows = asked.select("node", "dim", "home", "query", F.coalesce("reach", F.lit(4.0)).alias("reach"))
    return rows.mapInArrow(run, "node long, shard int, reach double")


def _search(spark: SparkSession, points: DataFrame, visits: DataFrame, boxes: list, greatest: dict[int, float], keep: int) -> DataFrame:
    """(node, other, first, score, distance): the best of the shards that queries visit.

    A shard of more points than planned is cut by hash, and a query visits all parts;
    a shard of many queries is copied, and each copy serves some of them.
    """
    visits = store(visits, "nearest-visits")
    asked = {r.shard: r.n for r in visits.df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.createDataFrame([(b.shard, -(-b.n // (2 * SHARD)), -(-asked[b.shard] // SERVED)) for b in boxes if b.shard in asked] or [(-1, 1, 1)], "shard int, parts int, copies int")
    own = lambda by, of: F.pmod(F.xxhash64(by), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    # One row a shard, of which the sample bounds the number.
    stored = points.join(F.broadcast(sizes), "shard").withColumn("part", own("node", "parts")).withColumn("copy", each("copies"))
    stored = stored.select("shard", "part", "copy", F.lit(0).alias("role"), "node", "dim", "vector", "at", "first", F.lit(0.0).alias("reach"))
    came = visits.df.join(F.broadcast(sizes), "shard").withColumn("copy", own("node", "copies")).withColumn("part", each("parts"))
    came = came.join(points.select("node", "dim", "vector", F.col("query").alias("at"), "first"), "node")
    came = came.select("shard", "part", "copy", F.lit(1).alias("role"), "node", "dim", "vector", "at", "first", "reach")
    place = ["shard", "part", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            edge = np.stack([b.column(c).to_numpy() for c in (*place, "role")], 1)
            cuts = [0, *(np.flatnonzero((edge[1:] != edge[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                where, role, rows = tuple(edge[lo, :3].tolist()), int(edge[lo, 3]), b.slice(lo, hi - lo)
                if where != now:
                    now, held, block = where, [], None
                if role == 0:
                    held.append(rows)
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block, held = _Block(pa.Table.from_batches(held)), []
                for s in range(0, rows.num_rows, TOGETHER):
                    yield block.answer(rows.slice(s, TOGETHER), greatest, keep)

    both = stored.unionByName(came).repartition(shuffle_partitions(spark), *place).sortWithinPartitions(*place, "role")
    return both.mapInArrow(run, "node long, other long, first long, score double, distance double")


class _Block:
    """The points of one part of a shard and their tree."""

    def __init__(self, rows: pa.Table):
        ((self.dim, _, self.points),) = _by_length(rows)
        self.node, self.first = rows.column("node").to_numpy(), rows.column("first").to_numpy()
        self.tree = Tree(np.array(rows.column("at").to_pylist()))

    def answer(self, rows: pa.RecordBatch, greatest: dict[int, float], keep: int) -> pa.RecordBatch:
        ((_, _, queries),) = _by_length(rows)
        at, node, reach = np.array(rows.column("at").to_pylist()), rows.column("node").to_numpy(), rows.column("reach").to_numpy()
        who, score = search(self.tree, self.points, self.first, greatest[self.dim], queries, at, reach, min(keep, len(self.points)))
        q, k = np.nonzero(who >= 0)
        distance = 2 - 2 * score[q, k] / (lengths(queries)[q] * greatest[self.dim])
        hit = who[q, k]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[q], self.node[hit], self.first[hit], score[q, k], distance)], ["node", "other", "first", "score", "distance"])


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op13_nearest_neighbours."""
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"))
