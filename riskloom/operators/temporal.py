"""What time does to features and target: drift, order, and power that a random split pretends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_text, col, number
from ..functions.kinds import NUMERIC, TEMPORAL
from .columns import ColumnStats
from .power import power_frame
from .ranks import ks_of, quantiles, rank_correlations, sided, total_variations, with_before
from .target import class_counts, eligible, predicted, task_of

ROWS, TIMES, EACH_SIDE, FEATURE_ROWS, DRIFT_ROWS = 1000, 10, 50, 500, 30
EARLY = 0.7
LEVELS = 100


@dataclass
class TemporalSignal:
    feature: str
    pps_random: float | None = None
    pps_time: float | None = None
    drift: float | None = None
    monotonicity: float | None = None
    severity: str = "none"
    leakage_kind: str = "none"

    @property
    def gap(self) -> float | None:
        return None if self.pps_random is None or self.pps_time is None else self.pps_random - self.pps_time


@dataclass
class TimeBucket:
    label: str
    n_rows: int
    n_target: int | None = None
    value: float | None = None


@dataclass
class TemporalReport:
    time_column: str
    n_rows: int
    signals: list[TemporalSignal] = field(default_factory=list)
    buckets: list[TimeBucket] = field(default_factory=list)
    drift_kind: str | None = None
    drift_score: float | None = None
    insufficient: str | None = None
    class_rates: list[float] = field(default_factory=list)

    @property
    def is_target_drifted(self) -> bool:
        if self.drift_score is None:
            return False
        least = {"binary": 0.2, "multiclass": 0.2, "regression_ratio": 2.0, "regression_diff": 1.0}
        return self.drift_score >= least.get(self.drift_kind or "", float("inf"))


def resolve_time(stats: dict[str, ColumnStats], asked: str | None) -> tuple[str | None, str | None]:
    """(column, message why there is none)."""
    if asked is not None:
        if asked not in stats:
            raise ValueError(f"time column {asked!r} isn't in the table")
        if stats[asked].kind != TEMPORAL:
            raise ValueError(f"time column {asked!r} is {stats[asked].dtype}; cast it to a date or timestamp first")
        return asked, None
    found = [n for n, s in stats.items() if s.kind == TEMPORAL]
    if len(found) == 1:
        return found[0], None
    return None, f"several columns hold times ({', '.join(found)}); name one" if found else None


def classify(random: float | None, time: float | None, drift: float | None, monotonicity: float | None, unique_share: float) -> tuple[str, str]:
    """(severity, leakage kind): the first rung that fits."""
    r, t, d = random or 0.0, time or 0.0, drift or 0.0
    both = random is not None and time is not None
    if both and r >= 0.35 and r - t >= 0.25:
        return "critical", "random_cv"
    if both and r >= 0.30 and t < 0.05 and r - t >= 0.25 and d >= 0.15:
        return "critical", "post_event"
    if d >= 0.3 and (r >= 0.1 or t >= 0.1):
        return "warning", "drift"
    if d >= 0.5:
        return "info", "strong_drift"
    if monotonicity is not None and monotonicity >= 0.95 and unique_share >= 0.9:
        return "warning", "monotonic"
    return "none", "none"


def infer_kind(severity: str, reason: str) -> str:
    """The leakage kind of a signal saved before kinds were."""
    said = reason.lower()
    if severity == "none":
        return "none"
    if severity == "critical":
        return "post_event" if "post" in said or "after the event" in said else "random_cv"
    if "monoton" in said:
        return "monotonic"
    return "strong_drift" if severity == "info" else "drift"


def numbered_times(df: DataFrame, time: str, target: Column | None = None) -> DataFrame:
    """(us, n, n_target, sum_y, before_n, before_n_target): rows of each time, and those with a target, counted and sorted once."""
    y = target if target is not None else F.lit(None).cast("double")
    per = df.select(F.unix_micros(col(time).cast("timestamp")).alias("us"), y.cast("double").alias("y")).where("us is not null").groupBy("us").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_target"), F.sum("y").alias("sum_y"))
    return with_before(per, "us", ["n", "n_target"])


def late_cut(df: DataFrame, time: str, numbered: DataFrame | None = None) -> int | None:
    """Microseconds from which rows are late, over all rows; the last time where it alone holds all after 70 %.

    numbered, here and below: the table's times as numbered_times() gives them, where the caller has them."""
    numbered = numbered_times(df, time) if numbered is None else numbered
    # One row.
    total = numbered.agg(F.sum("n").alias("total"))
    late = F.col("before_n") >= F.floor(F.lit(EARLY) * F.col("total"))
    return numbered.crossJoin(F.broadcast(total)).agg(F.coalesce(F.min(F.when(late, F.col("us"))), F.max("us"))).first()[0]


def is_late(time: str, cut: int | None) -> Column:
    return F.unix_micros(col(time).cast("timestamp")) >= F.lit(cut).cast("long")


def drift_frame(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], time: str, cut: int | None) -> DataFrame:
    """(feature, n_a, n_b, drift, monotonicity) of each feature over all timed rows: KS of numbers,
    total variation of at most 100 levels, and how well a number's order follows time. Null below the
    least rows of a side, or in all. The jobs are as many for 300 features as for 3."""
    rows = df.where(col(time).isNotNull())
    late = is_late(time, cut)
    numbers, levels = [n for n in names if stats[n].kind == NUMERIC], [n for n in names if stats[n].kind != NUMERIC]
    spark = df.sparkSession
    if not numbers and not levels:
        return spark.createDataFrame([], _DRIFT)
    enough = (F.col("n_a") >= DRIFT_ROWS) & (F.col("n_b") >= DRIFT_ROWS)
    named = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("c") + 1).alias("feature")
    out = None
    if numbers:
        values = [number(n) for n in numbers]
        # Every timed row is early or late, so one sort of the values serves distances and ranks.
        numbered = sided(rows, values, late)
        gap = ks_of(numbered)
        order = rank_correlations(rows, values, F.unix_micros(col(time).cast("timestamp")), numbered)
        steady = F.when(F.col("n") >= DRIFT_ROWS, F.abs("rho"))
        out = gap.join(F.broadcast(order), "c").select(named(numbers), "n_a", "n_b", F.when(enough, F.col("ks")).alias("drift"), steady.alias("monotonicity"))
    if levels:
        spread = total_variations(rows, [as_text(df.schema[n]) for n in levels], late)
        moved = F.when(enough & (F.col("levels") <= LEVELS), F.col("tv"))
        spread = spread.select(named(levels), "n_a", "n_b", moved.alias("drift"), F.lit(None).cast("double").alias("monotonicity"))
        out = spread if out is None else out.unionByName(spread)
    return out


_DRIFT = "feature string, n_a long, n_b long, drift double, monotonicity double"
_FIGURES = ("pps_random", "pps_time", "drift", "monotonicity")


def temporal_figures(df: DataFrame, stats: dict[str, ColumnStats], time: str, target: str | None, numbered: DataFrame | None = None) -> DataFrame:
    """(feature, pps_random, pps_time, drift, monotonicity) of features with at least 500 timed rows, over all of them."""
    names = [n for n in eligible(stats, target) if n != time]
    cut = late_cut(df, time, numbered)
    drift = drift_frame(df, stats, names, time, cut).where(F.col("n_a") + F.col("n_b") >= FEATURE_ROWS)
    if target is None or not names:
        return drift.select("feature", *[F.lit(None).cast("double").alias(f) for f in _FIGURES[:2]], *_FIGURES[2:])
    classification = task_of(stats[target]) == "classification"
    rows = df.where(col(time).isNotNull())
    power = power_frame(rows, stats, names, target, classification, predicted(df, stats, target), is_late(time, cut), each_side=EACH_SIDE)
    return drift.join(F.broadcast(power.select("feature", *_FIGURES[:2])), "feature", "left").select("feature", *_FIGURES)


def bucket_frame(df: DataFrame, time: str, target: Column | None = None, buckets: int = 10) -> DataFrame:
    """(bucket, low, high, n_rows, n_target, value): equal row counts in time order, like ntile, over all rows.

    Times are counted first and numbered in ranges, so rows never meet in one
    task. Rows of one time share a bucket where ntile would cut through them by
    their unordered position: the bucket of the first of them.
    """
    return buckets_of(numbered_times(df, time, target), buckets)


def buckets_of(numbered: DataFrame, buckets: int = 10) -> DataFrame:
    """bucket_frame of numbered times."""
    # One row.
    total = numbered.agg(F.sum("n").alias("total"))
    placed = numbered.crossJoin(F.broadcast(total))
    q, r = F.floor(F.col("total") / buckets), F.col("total") % buckets
    b = F.col("before_n")
    bucket = F.when(b < r * (q + 1), F.floor(b / (q + 1))).otherwise(r + F.floor((b - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return placed.groupBy(bucket.cast("int").alias("bucket")).agg(
        F.timestamp_micros(F.min("us")).alias("low"), F.timestamp_micros(F.max("us")).alias("high"), F.sum("n").alias("n_rows"), F.sum("n_target").alias("n_target"), (F.sum("sum_y") / F.nullif(F.sum("n_target").cast("double"), F.lit(0.0))).alias("value")
    )


def exact_buckets(df: DataFrame, time: str, target: Column | None = None) -> DataFrame:
    """The same figures for each distinct time."""
    y = target if target is not None else F.lit(None).cast("double")
    return df.select(col(time).alias("t"), y.cast("double").alias("y")).where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"), F.count("y").alias("n_target"), F.avg("y").alias("value"))


def followed(df: DataFrame, stats: dict[str, ColumnStats], target: str | None) -> Column | None:
    """What a target's course over time is the mean of: itself, or 1 for its rarest class and 0 for the others."""
    if not target:
        return None
    if task_of(stats[target]) != "classification":
        return number(target)
    least = class_counts(df, target).orderBy("n", "value").first()
    minority = least.value if least else None
    text = as_text(df.schema[target])
    return F.when(text.isNotNull(), (text == F.lit(minority)).cast("double"))


def time_buckets(df: DataFrame, stats: dict[str, ColumnStats], time: str, target: str | None, y: Column | None, numbered: DataFrame | None = None) -> list[TimeBucket]:
    """At most 14 times stand for themselves; more are cut into ten parts. y: what followed() gives."""
    if stats[time].n_unique <= 14:
        rows = exact_buckets(df, time, y).orderBy("t").collect()
        return [TimeBucket(str(r.t), r.n_rows, r.n_target if target else None, r.value) for r in rows]
    rows = buckets_of(numbered_times(df, time, y) if numbered is None else numbered).orderBy("bucket").collect()
    day = stats[time].dtype == "date"
    show = lambda t: str(t.date() if day else t)
    return [TimeBucket(f"{show(r.low)} - {show(r.high)}", r.n_rows, r.n_target if target else None, r.value) for r in rows]


def bucket_drift(buckets: list[TimeBucket], classification: bool) -> tuple[str | None, float | None]:
    values = [b.value for b in buckets if b.value is not None]
    if len(values) < 2:
        return None, None
    low, high = min(values), max(values)
    if classification:
        return "binary", high - low
    if low > 0 or high < 0:
        return "regression_ratio", max(abs(low), abs(high)) / min(abs(low), abs(high))
    return "regression_diff", None


def target_drift(df: DataFrame, time: str, target: str, classification: bool, numbered: DataFrame | None = None) -> tuple[str | None, float | None]:
    """Drift of the target over ten equal parts of all labelled rows in time order; needs 100."""
    y = as_text(df.schema[target]) if classification else number(target)
    rows = df.select(col(time), y.alias("y")).where(col(time).isNotNull() & F.col("y").isNotNull())
    if numbered is None:
        numbered = numbered_times(df, time, F.when(y.isNotNull(), F.lit(1.0)))
    labelled = numbered.where("n_target > 0").select("us", F.col("n_target").alias("n"), "n_target", "sum_y", F.col("before_n_target").alias("before_n"))
    parts = buckets_of(labelled).orderBy("bucket").select(F.unix_micros("low").alias("low"), "n_rows").collect()
    if sum(p.n_rows for p in parts) < 100:
        return None, None
    size = {i: p.n_rows for i, p in enumerate(parts)}
    us = F.unix_micros(col(time).cast("timestamp"))
    part = F.lit(0)
    for p in parts[1:]:
        part = part + (us >= F.lit(p.low)).cast("int")
    dealt = rows.select(part.alias("part"), "y")
    if classification:
        share = [F.coalesce(F.max(F.when(F.col("part") == i, F.col("n"))), F.lit(0)) / F.lit(float(n)) for i, n in size.items()]
        rates = dealt.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("y").agg(F.array_max(F.array(*share)).alias("high"), F.array_min(F.array(*share)).alias("low"))
        levels, spread = rates.agg(F.count(F.lit(1)), F.max(F.col("high") - F.col("low"))).first()
        return (None, None) if levels < 2 else ("binary" if levels == 2 else "multiclass", float(spread))
    means = [r.m for r in dealt.groupBy("part").agg(F.avg("y").alias("m")).collect()]
    low, high = min(means), max(means)
    if low > 0 or high < 0:
        return "regression_ratio", float(max(abs(low), abs(high)) / min(abs(low), abs(high)))
    counts = rows.select(F.lit(0).alias("c"), F.col("y").alias("v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    q1, q3 = quantiles(with_before(counts, ["c", "v"], ["n"]), (0.25, 0.75)).first().q
    scale = float(q3 - q1) or float(rows.agg(F.stddev_pop("y")).first()[0])
    return "regression_diff", float((high - low) / scale) if scale > 0 else None


def demote_ingest_order(signals: list[TemporalSignal]) -> None:
    """Where most features just follow the order of arrival, their warnings say little."""
    steady = [s for s in signals if (s.monotonicity or 0) >= 0.95]
    if len(steady) > max(2, len(signals) // 2):
        for s in steady:
            if s.severity == "warning":
                s.severity = "info"


def temporal_report(df: DataFrame, stats: dict[str, ColumnStats], time: str, target: str | None) -> TemporalReport | None:
    """None below 1,000 timed rows; buckets alone below ten distinct times."""
    s = stats[time]
    if s.non_null < ROWS:
        return None
    report = TemporalReport(time, s.non_null)
    classification = bool(target) and task_of(stats[target]) == "classification"
    y = followed(df, stats, target)
    numbered = numbered_times(df, time, y) if s.n_unique >= TIMES else None
    report.buckets = time_buckets(df, stats, time, target, y, numbered)
    if target:
        report.drift_kind, report.drift_score = bucket_drift(report.buckets, classification)
    if s.n_unique < TIMES:
        return report
    if not [n for n in eligible(stats, target) if n != time]:
        report.insufficient = "no feature can be followed over time"
        return report
    for r in temporal_figures(df, stats, time, target, numbered).collect():
        f = {k: (None if r[k] is None or r[k] != r[k] else r[k]) for k in _FIGURES}
        of = stats[r.feature]
        severity, kind = classify(f["pps_random"], f["pps_time"], f["drift"], f["monotonicity"], of.unique_rate)
        report.signals.append(TemporalSignal(r.feature, **f, severity=severity, leakage_kind=kind))
    if target:
        kind, score = target_drift(df, time, target, classification, numbered)
        if kind:
            report.drift_kind, report.drift_score = kind, score
    demote_ingest_order(report.signals)
    rank = {"critical": 0, "warning": 1, "info": 2, "none": 3}
    report.signals.sort(key=lambda x: (rank[x.severity], -(x.gap if x.gap is not None else 0.0), -(x.drift or 0.0), x.feature))
    return report


__all__ = ["TemporalReport", "TemporalSignal", "TimeBucket", "bucket_frame", "classify", "drift_frame", "resolve_time", "temporal_report"]
