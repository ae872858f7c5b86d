"""Samples that depend on content, multiplicity and seed alone, not on partitioning."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import col, hashable, quoted
from ..functions.kinds import OTHER, kind_of

SEED = 42


def exact_sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows, or all: a simple random sample in which equal rows count as often as they occur."""
    # The first key of a group is its least, so a group beyond the n least first keys has no row in the sample.
    heads = least_of_few(_groups(df, [], seed), n).orderBy(_FIRST, _A, _B).limit(n)

    def run(batches):
        got = list(batches)
        if got:
            yield drawn(pd.concat(got), n)

    return _rows(df, heads.coalesce(1).mapInPandas(run, f"{_A} long, {_B} long, {_TAKE} long"), seed)


def stratified_sample(df: DataFrame, target: str, most: int, n_classes: int, seed: int = SEED) -> DataFrame:
    """most // n_classes rows of each class, null classes out, equal rows as above."""
    each = max(1, most // max(1, n_classes))
    rows = df.where(col(target).isNotNull())
    w = Window.partitionBy(_CLASS).orderBy(_FIRST, _A, _B)
    heads = least_of_few(_groups(rows, [hashable(df.schema[target]).alias(_CLASS)], seed), each).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= each)
    return _rows(rows, heads.groupBy(_CLASS).applyInPandas(lambda g: drawn(g, each), f"{_A} long, {_B} long, {_TAKE} long"), seed)


def least_of_few(groups: DataFrame, each: int) -> DataFrame:
    """The groups with the `each` least first keys of every class among them, from about as many tasks as the root of those there were.

    What all tasks hand on grows with their number, and that with the table. Merged over two
    steps, no task reads more than about the root of their number times the sample.
    """
    few = math.isqrt(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    return least_of_tasks(least_of_tasks(groups, each).repartition(few, _A), each)


def least_of_tasks(groups: DataFrame, each: int) -> DataFrame:
    """Of each task, the groups with the `each` least first keys of every class (or of all), so that few of a large class meet in one task.

    Spark limits a window before its shuffle up to 1,000 rows only (spark.sql.optimizer.windowGroupLimitThreshold).
    """
    classed = _CLASS in groups.columns

    def least(found: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Array | None, np.ndarray]:
        """What is kept of them, the classes, and the greatest first key that each class may still take."""
        table = pa.Table.from_batches(found).combine_chunks()
        first, a, b = (table[c].to_numpy() for c in (_FIRST, _A, _B))
        order = np.lexsort((b, a, first))
        if not classed:
            order = order[:each]
            return table.take(order), None, np.array([first[order[-1]] if 0 < each == len(order) else np.inf])
        named = table[_CLASS].combine_chunks().dictionary_encode("encode")
        codes = named.indices.to_numpy()[order]
        place = pd.Series(codes).groupby(codes, sort=False).cumcount().to_numpy()
        bounds = np.full(len(named.dictionary), np.inf)
        bounds[codes[place == each - 1]] = first[order[place == each - 1]]
        return table.take(order[place < each]), named.dictionary, bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, classes, bounds = [], 0, None, np.array([np.inf])
        for b in batches:
            # A class not met yet has the last place, which is open.
            at = 0 if classes is None else pc.fill_null(pc.index_in(b.column(_CLASS), classes), len(classes)).to_numpy(zero_copy_only=False)
            held.append(b.filter(pa.array(b.column(_FIRST).to_numpy() <= bounds[at])))
            waiting += held[-1].num_rows
            if waiting >= max(HELD, each):
                kept, classes, bounds = least(held)
                bounds = np.append(bounds, np.inf)
                held, waiting = kept.to_batches(), 0
        if held:
            yield from least(held)[0].to_batches()

    return groups.mapInArrow(run, groups.schema)


#: Groups that a task reads, as many as it keeps at least, before it drops those beyond the least of their class.
HELD = 100_000
_A, _B, _N, _FIRST, _TAKE, _CLASS = "__a", "__b", "__n", "__first", "__take", "__class"


def _content(schema: T.StructType, seed: int) -> list[Column]:
    """128 bits of a row's content. Hashes skip nulls, so where they stand is hashed too."""
    parts = [hashable(f) for f in schema]
    return [F.xxhash64(F.lit(seed + k), *parts, *[p.isNull() for p in parts]).alias(name) for k, name in enumerate((_A, _B))]


def _groups(df: DataFrame, also: list[Column], seed: int) -> DataFrame:
    """A row for each group of equal rows: content hash, size and the least of as many exponential keys; only hashes are shuffled."""
    counts = df.select(*_content(df.schema, seed), *also).groupBy(_A, _B, *([_CLASS] if also else [])).agg(F.count(F.lit(1)).alias(_N))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), _A, _B, F.lit(1)), 11) + 0.5) / F.lit(2.0**53)
    return counts.withColumn(_FIRST, -F.log(uniform) / F.col(_N))


def _uniform(a: int, b: int, k: int) -> float:
    """Of content hash and occurrence number (splitmix64)."""
    x = (a ^ (b * 0xD6E8FEB86659FD93) ^ (k * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


_MASK = 2**64 - 1


def drawn(groups: pd.DataFrame, n: int) -> pd.DataFrame:
    """How many rows of each group are among the n least keys of all.

    A row's key is exponential. Those of a group come in rising order (the gap
    after the k-th of m is exponential over m - k), so however large a group is,
    only keys that are drawn are made.
    """
    heap = [(first, a, b, 1, m) for a, b, m, first in zip(*(groups[c].tolist() for c in (_A, _B, _N, _FIRST)))]
    heapq.heapify(heap)
    take: dict[tuple[int, int], int] = {}
    for _ in range(n):
        if not heap:
            break
        key, a, b, k, m = heap[0]
        take[a, b] = k
        if k < m:
            heapq.heapreplace(heap, (key - math.log(_uniform(a, b, k + 1)) / (m - k), a, b, k + 1, m))
        else:
            heapq.heappop(heap)
    return pd.DataFrame([(a, b, k) for (a, b), k in take.items()], columns=[_A, _B, _TAKE])


def _rows(df: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """The rows drawn, in the order of a hash of content and occurrence number; draws are bounded by the size of the sample."""
    held = [f for f in df.schema if kind_of(f.dataType) == OTHER]
    plain = [quoted(f.name) for f in df.schema if f not in held]
    hits = df.select("*", *_content(df.schema, seed)).join(F.broadcast(draws), [_A, _B])
    one = hits.groupBy(_A, _B, _TAKE, *plain)
    one = one.agg(*[F.first(col(f.name)).alias(f.name) for f in held]) if held else one.agg(F.count(F.lit(1)).alias(_N))
    copies = one.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col(_TAKE))))
    # One partition of the bounded sample, so that its order doesn't follow the shuffle.
    return copies.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(seed), _A, _B, "__k"), _A, _B, "__k").select(*[col(n) for n in df.columns])


def target_sample(df: DataFrame, target: str, most: int, n_classes: int | None) -> DataFrame:
    """Labelled rows for target analysis: by class for 2 to 20 classes, else by hash."""
    if n_classes is not None and 2 <= n_classes <= 20:
        return stratified_sample(df, target, most, n_classes)
    return exact_sample(df.where(col(target).isNotNull()), most)


def capped(names: list[str], most: int | None, priority: list[str]) -> list[str]:
    """At most so many of names: those of the priority list in its order first, then the others in theirs."""
    if most is None or len(names) <= most:
        return list(names)
    order = [n for n in dict.fromkeys(priority) if n in names]
    return (order + [n for n in names if n not in order])[:most]
