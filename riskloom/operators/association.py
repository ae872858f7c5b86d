"""Association of pairs of columns: Pearson over all rows, mutual information over a sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.expr import as_text, col, guarded_corr, number
from ..functions.kinds import BOOL, NUMERIC, TEXT
from ..sources.sampling import exact_sample, capped
from .columns import ColumnStats
from .power import bins_of

PAIR_SAMPLE, PAIR_LEVELS, JOINT_ROWS = 20_000, 50, 30
NONLINEAR = 0.15


@dataclass
class Pair:
    a: str
    b: str
    pearson: float | None = None
    mutual_info: float | None = None

    @property
    def score(self) -> float:
        return max(abs(self.pearson or 0.0), self.mutual_info or 0.0)

    @property
    def is_nonlinear(self) -> bool:
        return self.mutual_info is not None and self.mutual_info - abs(self.pearson or 0.0) > NONLINEAR


def pearson_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, pearson) of all pairs over all rows that have both; null without spread or with a non-finite sum.

    Two scans of the columns: their means, then products of the values less these
    means, summed as matrices for each Arrow batch (one product for all pairs, where
    an aggregate for each would be thousands of expressions); tasks hand on one row a pair.
    """
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string, pearson double")
    wide = df.select(*[number(n).alias(f"c{i}") for i, n in enumerate(names)])
    first = wide.agg(*[F.avg(c).alias(c) for c in wide.columns]).first()
    shift = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in first])
    left, right = np.triu_indices(len(names), 1)
    figures = ("n", "sx", "sy", "qx", "qy", "p")
    schema = "i int, j int, " + ", ".join(f"{f} double" for f in figures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shift)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1) if b.num_rows else np.empty((0, k))
            null = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in b.columns], 1)
            there = (~null).astype(float)
            x = np.where(null, 0.0, x - shift)
            with np.errstate(all="ignore"):
                n += there.T @ there
                s += x.T @ there
                q += (x * x).T @ there
                p += x.T @ x
        values = (n[left, right], s[left, right], s[right, left], q[left, right], q[right, left], p[left, right])
        yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *map(pa.array, values)], ["i", "j", *figures])

    sums = wide.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in figures])
    vx, vy = (F.greatest(F.col(f"q{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n"), F.lit(0.0)) for c in "xy")
    # Spread below the rounding of the sums is none.
    flat = (F.col("n") < 2) | (vx <= F.col("qx") * 1e-14) | (vy <= F.col("qy") * 1e-14)
    r = (F.col("p") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)
    r = F.when(~flat & ~F.isnan(r) & (F.abs(r) < float("inf")), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    return sums.select(name("i").alias("a"), name("j").alias("b"), r.alias("pearson"))


def class_information(df: DataFrame, stats: dict[str, ColumnStats], names: list[str]) -> DataFrame:
    """(a, b, n, nats, mutual_info) of all pairs of categorical columns over all rows that have both.

    One table of counts for all pairs: tasks hand on the cells of each pair (at most 50 x 50).
    """
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string, n long, nats double, mutual_info double")
    bins = list(bins_of(df, stats, names).values())
    pairs = list(combinations(range(len(names)), 2))
    width = max(max(len(b.values) for b in bins), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(bins[i].values), len(bins[j].values)), np.int64) for i, j in pairs]
        for b in batches:
            at = [own.codes(c) for own, c in zip(bins, b.columns)]
            for k, (i, j) in enumerate(pairs):
                ok = (at[i] >= 0) & (at[j] >= 0)
                total[k] += np.bincount(at[i][ok] * total[k].shape[1] + at[j][ok], minlength=total[k].size).reshape(total[k].shape)
        for k, t in enumerate(total):
            x, y = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(t[x, y])], ["k", "x", "y", "n"])

    wide = df.select(*[(number(n) if b.number else as_text(df.schema[n])).alias(f"c{i}") for i, (n, b) in enumerate(zip(names, bins))])
    cells = wide.mapInArrow(run, "k int, x int, y int, n long").groupBy("k", "x", "y").agg(F.sum("n").alias("n"))

    def nats(own: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((width, width))
        t[own.x, own.y] = own.n
        p = t / t.sum()
        q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        found = max(0.0, float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()))
        i, j = pairs[int(own.k.iloc[0])]
        return pd.DataFrame([(names[i], names[j], int(t.sum()), found, numeric.normalised(found))], columns=["a", "b", "n", "nats", "mutual_info"])

    return cells.groupBy("k").applyInPandas(nats, "a string, b string, n long, nats double, mutual_info double")


def information_columns(stats: dict[str, ColumnStats]) -> list[str]:
    return [n for n, s in stats.items() if not s.is_constant and (s.kind == NUMERIC or (s.kind in (TEXT, BOOL) and s.n_unique <= PAIR_LEVELS))]


def encoded(df: DataFrame, names: list[str], stats: dict[str, ColumnStats]) -> pd.DataFrame:
    """A bounded sample as numbers: categories by the order of their text, missing as NaN."""
    chosen = df.select(*[(number(n) if stats[n].kind == NUMERIC else as_text(df.schema[n])).alias(f"c{i}") for i, n in enumerate(names)]).toPandas()
    out = {}
    for i, n in enumerate(names):
        v = chosen[f"c{i}"]
        out[n] = v.astype(float) if stats[n].kind == NUMERIC else codes(v)
    return pd.DataFrame(out)


def codes(v: pd.Series) -> pd.Series:
    levels = {x: i for i, x in enumerate(sorted(v.dropna().unique()))}
    return v.map(levels).astype(float)


def information(x: np.ndarray, y: np.ndarray, x_classes: bool, y_classes: bool) -> float:
    """Normalised mutual information of what two columns have jointly; y is the target."""
    if y_classes:
        nats = numeric.mutual_information_classes(x, y) if x_classes else numeric.mutual_information_mixed(x, y)
    else:
        nats = numeric.mutual_information_mixed(y, x) if x_classes else numeric.mutual_information_numbers(x, y)
    return numeric.normalised(nats)


def information_pairs(df: DataFrame, stats: dict[str, ColumnStats], max_cols: int | None = None, priority: list[str] | None = None) -> DataFrame:
    """(a, b, mutual_info) of eligible pairs, b as the target: of two categorical columns over all rows,
    of others by nearest neighbours over one sample, a task for each pair."""
    spark = df.sparkSession
    names = capped(information_columns(stats), max_cols, priority or [])
    schema = "a string, b string, mutual_info double"
    classes = {n: stats[n].kind != NUMERIC for n in names}
    levels = [n for n in names if classes[n]]
    out = class_information(df, stats, levels).where(F.col("n") >= JOINT_ROWS).select("a", "b", "mutual_info")
    pairs = [p for p in combinations(names, 2) if not (classes[p[0]] and classes[p[1]])]
    if not pairs:
        return out
    # The sample is bounded (PAIR_SAMPLE rows), so each task can hold it whole.
    shared = spark.sparkContext.broadcast(encoded(exact_sample(df.select(*[col(n) for n in names]), PAIR_SAMPLE), names, stats))

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.a, batch.b):
                x, y = shared.value[a].to_numpy(), shared.value[b].to_numpy()
                ok = ~(np.isnan(x) | np.isnan(y))
                if ok.sum() >= JOINT_ROWS:
                    out.append((a, b, information(x[ok], y[ok], classes[a], classes[b])))
            yield pd.DataFrame(out, columns=["a", "b", "mutual_info"])

    asked = spark.createDataFrame(pairs, "a string, b string").repartition(min(len(pairs), 4 * spark.sparkContext.defaultParallelism))
    return out.unionByName(asked.mapInPandas(run, schema))


def correlation_pairs(df: DataFrame, stats: dict[str, ColumnStats], deep: bool = True, max_cols: int | None = None, priority: list[str] | None = None) -> list[Pair]:
    """Pairs by falling score, ties by name."""
    numbers = capped([n for n, s in stats.items() if s.kind == NUMERIC and not s.is_constant], max_cols, priority or [])
    found = {(r.a, r.b): Pair(r.a, r.b, r.pearson) for r in pearson_pairs(df, numbers).collect() if r.pearson is not None}
    if deep:
        for r in information_pairs(df, stats, max_cols, priority).collect():
            key = (r.a, r.b) if (r.b, r.a) not in found else (r.b, r.a)
            found.setdefault(key, Pair(*key)).mutual_info = r.mutual_info
    return sorted(found.values(), key=lambda p: (-p.score, p.a, p.b))


def strengths(df: DataFrame, stats: dict[str, ColumnStats], target: str) -> dict[str, float | None]:
    """Absolute correlation of each numeric column with a numeric target."""
    numbers = [n for n, s in stats.items() if s.kind == NUMERIC and n != target]
    got = df.agg(*[F.abs(guarded_corr(number(n), number(target))).alias(f"p{i}") for i, n in enumerate(numbers)]).first() if numbers else []
    return dict(zip(numbers, got))


def univariate_priority(df: DataFrame, stats: dict[str, ColumnStats], target: str | None) -> list[str]:
    """Names by what they promise alone: correlation with a numeric target, or the number of levels short of unique."""
    of = stats.get(target) if target else None
    strength = strengths(df, stats, target) if of is not None and of.kind == NUMERIC else {}

    def key(n: str):
        s = stats[n]
        return (-(strength.get(n) or 0.0), -(s.n_unique if s.n_unique < s.non_null else 0), n)

    return sorted((n for n in stats if n != target), key=key)
