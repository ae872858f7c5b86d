"""Rank statistics over all rows, of any number of columns at once.

Columns are stacked to rows (column number, value), counted, and sorted once by
column and value in ranges; running sums inside the ranges and the totals of the
ranges before, one row a range, number all values. So the number of jobs doesn't
follow the number of columns. What is numbered is written: bounds that Spark
samples for an exchange hold for totals and rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import kept


def _numbered(counts: DataFrame, value: list[str], sums: list[str]) -> DataFrame:
    """counts in as many ranges as shuffle partitions, each of about as many values, written: with the range (_part)
    and for each column s of sums its total over smaller values of the same range (_i_s)."""
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.withColumns({s: F.col(s).cast("long") for s in sums}).repartitionByRange(ranges, *value).sortWithinPartitions(*value)
    schema = T.StructType([*dealt.schema, T.StructField("_part", T.IntegerType()), *[T.StructField(f"_i_{s}", T.LongType()) for s in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for b in batches:
            inside = []
            for s in sums:
                own = b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                inside.append(pa.array(at[s] + total - own))
                at[s] += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), *inside], schema.names)

    return kept(dealt.mapInArrow(run, schema), "ranked")


def with_before(counts: DataFrame, value: str | list[str], sums: list[str]) -> DataFrame:
    """counts (one row per non-null value, or per values of several columns) with, for each column s of sums, before_s: its total over smaller values."""
    numbered = _numbered(counts, [value] if isinstance(value, str) else value, sums)
    totals = numbered.groupBy("_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range, so this window's single task and the broadcast are bounded.
    shift = totals.select("_part", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_s_{s}") for s in sums])
    out = numbered.join(F.broadcast(shift), "_part")
    return out.select(*counts.columns, *[(F.col(f"_i_{s}") + F.col(f"_s_{s}")).alias(f"before_{s}") for s in sums])


def with_before_each(counts: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """counts (one row per c and value) with, for each column s of sums, before_s: its total over smaller values of
    the same c, and all_s: its total of that c. The written rows are read once for all bounds."""
    numbered = _numbered(counts, ["c", value], sums)
    totals = numbered.groupBy("_part", "c").agg(*[f for s in sums for f in (F.sum(s).alias(f"_t_{s}"), F.min(f"_i_{s}").alias(f"_0_{s}"))])
    own = Window.partitionBy("c")
    earlier = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges are sorted by c: at most a row a range and one a column.
    before = [(F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)) - F.col(f"_0_{s}")).alias(f"_s_{s}") for s in sums]
    shift = totals.select("_part", "c", *before, *[F.sum(f"_t_{s}").over(own).alias(f"all_{s}") for s in sums])
    out = numbered.join(F.broadcast(shift), ["_part", "c"])
    return out.select(*counts.columns, *[(F.col(f"_i_{s}") + F.col(f"_s_{s}")).alias(f"before_{s}") for s in sums], *[f"all_{s}" for s in sums])


def stacked(df: DataFrame, values: list[Column], **also: Column) -> DataFrame:
    """(c, v, also..) with a row for each non-null value; c is its place in values."""
    if not values:
        kind = df.select(*[x.alias(n) for n, x in also.items()]).schema
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("c", T.IntegerType()), T.StructField("v", T.DoubleType()), *kind]))
    items = [F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(values)]
    wide = df.select(*[x.alias(n) for n, x in also.items()], F.array(*items).alias("_x"))
    return wide.select(F.inline("_x"), *also).select("c", "v", *also).where("v is not null")


def sided(df: DataFrame, values: list[Column], second: Column) -> DataFrame:
    """(c, v, a, b, before_a, before_b, all_a, all_b): each value's rows on the first and the second side, numbered. Rows without a side are out."""
    counts = stacked(df, values, g=second).where("g is not null").groupBy("c", "v").agg(F.sum((~F.col("g")).cast("long")).alias("a"), F.sum(F.col("g").cast("long")).alias("b"))
    return with_before_each(counts, "v", ["a", "b"])


def _share(x: Column, total: str) -> Column:
    return x / F.nullif(F.col(total).cast("double"), F.lit(0.0))


def ks_of(numbered: DataFrame) -> DataFrame:
    """(c, n_a, n_b, ks) of what sided() gives: the largest gap between the two distribution functions."""
    gap = F.abs(_share(F.col("before_a") + F.col("a"), "all_a") - _share(F.col("before_b") + F.col("b"), "all_b"))
    return numbered.groupBy("c").agg(F.first("all_a").alias("n_a"), F.first("all_b").alias("n_b"), F.max(gap).alias("ks"))


def auc_of(numbered: DataFrame) -> DataFrame:
    """(c, n_pos, n_neg, auc, lift) of what sided() gives: Mann-Whitney of side b with mean ranks at ties; null if a side is empty."""
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / F.lit(2.0)
    sums = numbered.groupBy("c").agg(F.first("all_b").alias("n_pos"), F.first("all_a").alias("n_neg"), F.sum(F.col("b") * rank).alias("r"))
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    area = (F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))
    return sums.select("c", "n_pos", "n_neg", area.alias("auc"), (2 * F.abs(area - 0.5)).alias("lift"))


def total_variations(df: DataFrame, values: list[Column], late: Column) -> DataFrame:
    """(c, levels, n_a, n_b, tv): half the summed difference of the two distributions of each categorical column."""
    if not values:
        return df.sparkSession.createDataFrame([], "c int, levels long, n_a long, n_b long, tv double")
    long = stacked(df, [x.cast("string") for x in values], g=late).where("g is not null")
    # Levels are told apart by 128 bits: texts aren't exchanged.
    counts = long.groupBy("c", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("k")).agg(F.sum((~F.col("g")).cast("long")).alias("a"), F.sum(F.col("g").cast("long")).alias("b"))
    sides = long.groupBy("c").agg(F.sum((~F.col("g")).cast("long")).alias("n_a"), F.sum(F.col("g").cast("long")).alias("n_b"))
    gap = F.abs(_share(F.col("a"), "n_a") - _share(F.col("b"), "n_b"))
    return counts.join(F.broadcast(sides), "c").groupBy("c").agg(F.count(F.lit(1)).alias("levels"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), (F.sum(gap) / 2).alias("tv"))


def rank_correlations(df: DataFrame, values: list[Column], y: Column, numbered: DataFrame | None = None) -> DataFrame:
    """(c, n, rho): each column against y over rows that have both, mean ranks at ties; rho is null without spread.

    Ranks of a value go to its rows, are summed for each y, and meet y's ranks among the rows that have the column.
    numbered: what sided() gave for the same values, if every row with y has a side and no other: the values needn't be sorted again.
    """
    rows = stacked(df, values, y=y).where("y is not null")
    centred = lambda n, before, total: F.col(before) + (F.col(n) + 1) / F.lit(2.0) - (F.col(total) + 1) / F.lit(2.0)
    if numbered is None:
        counted = with_before_each(rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), "v", ["n"])
    else:
        counted = numbered.select("c", "v", *[(F.col(f"{p}a") + F.col(f"{p}b")).alias(f"{p}n") for p in ("", "before_", "all_")])
    ranked = counted.select("c", "v", "n", centred("n", "before_n", "all_n").alias("r"))
    spread = ranked.groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("xx"))
    summed = rows.join(ranked.select("c", "v", "r"), ["c", "v"]).groupBy("c", "y").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    second = with_before_each(summed, "y", ["n"]).select("c", "s", "n", centred("n", "before_n", "all_n").alias("r"))
    both = second.groupBy("c").agg(F.sum(F.col("s") * F.col("r")).alias("xy"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("yy"))
    rho = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return spread.join(F.broadcast(both), "c").select("c", "n", rho.alias("rho"))


def average_ranks(df: DataFrame, value: Column) -> DataFrame:
    """(v, n, rank): the mean rank of each distinct non-null value."""
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return with_before(counts, "v", ["n"]).select("v", "n", (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def quantiles_at(at: tuple[float, ...]) -> tuple[list[Column], Column]:
    """(aggregates, array over them): quantiles by linear interpolation of counted values v, n of which stand from
    place `at` on among `total`; rows without a place don't count."""
    place = lambda q: (F.col("total") - 1) * F.lit(q)
    holds = lambda k: (F.col("at") <= k) & (k < F.col("at") + F.col("n"))
    found = []
    for i, q in enumerate(at):
        found += [F.max(F.when(holds(F.floor(place(q))), F.col("v"))).alias(f"a{i}"), F.max(F.when(holds(F.ceil(place(q))), F.col("v"))).alias(f"b{i}")]
    between = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place(q) - F.floor(place(q))) for i, q in enumerate(at)]
    return found, F.when(F.col("total") > 0, F.array(*between))


def quantiles(numbered: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """(c, q): quantiles of numbered values (c, v, n, before_n)."""
    found, q = quantiles_at(at)
    # One row a column.
    size = numbered.groupBy("c").agg(F.min("before_n").alias("_0"), F.sum("n").alias("total"))
    within = numbered.join(F.broadcast(size), "c").withColumn("at", F.col("before_n") - F.col("_0"))
    return within.groupBy("c").agg(F.first("total").alias("total"), *found).select("c", q.alias("q"))
