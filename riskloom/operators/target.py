"""What each feature says about the target."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.expr import as_text, col, number
from ..functions.kinds import BOOL, NUMERIC, OTHER, TEMPORAL, TEXT
from ..sources.sampling import target_sample
from .association import codes, information
from .columns import ColumnStats
from .forest import permutation_importance
from .neighbours import level_information, number_information
from .power import CLASSES_KEPT, power_frame
from .ranks import auc_of, rank_correlations, sided

CLASSES, FEATURE_LEVELS, SUPPORT, TARGET_SAMPLE = 20, 100, 30, 30_000
LEAK, LEAK_BESIDE, WEAK_SIGNAL = 0.85, 0.6, 0.05


@dataclass
class TargetSummary:
    name: str
    task: str
    n: int
    n_missing: int
    classes: list[tuple[str, int]] = field(default_factory=list)
    positive: str | None = None
    positive_count: int | None = None
    positive_rate: float | None = None
    mean: float | None = None


@dataclass
class TargetSignal:
    feature: str
    pps: float = 0.0
    mutual_info: float | None = None
    spearman: float | None = None
    auc: float | None = None
    auc_lift: float | None = None
    permutation: float | None = None
    n: int = 0
    positive_count: int | None = None
    auc_ci: tuple[float, float] | None = None
    mutual_info_ci: tuple[float, float] | None = None
    pps_mean: float | None = None
    pps_cov: float | None = None
    leak_suspect: bool = False

    @property
    def best_score(self) -> float:
        """Without rank correlation, as everywhere where scores are compared."""
        return max(self.pps, self.mutual_info or 0.0, self.auc_lift or 0.0, self.permutation or 0.0)

    @property
    def confidence(self) -> str:
        p = self.positive_count
        if self.n < 200 or (p is not None and p < 30):
            return "low"
        if self.n < 1000 or (p is not None and p < 100):
            return "medium"
        return "high"


def task_of(s: ColumnStats) -> str:
    if s.kind in (TEMPORAL, OTHER):
        raise ValueError(f"column {s.name!r} of type {s.dtype} can't be a target")
    return "classification" if s.kind in (TEXT, BOOL) or s.n_unique <= CLASSES else "regression"


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(value, n) of the target's non-null values as text, ordered by value."""
    return df.select(as_text(df.schema[target]).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def summarise(df: DataFrame, stats: dict[str, ColumnStats], target: str) -> TargetSummary:
    s = stats[target]
    out = TargetSummary(target, task_of(s), s.n, s.n_null, mean=s.mean)
    if out.task == "classification":
        counts = class_counts(df, target)
        # The most frequent classes, and of very many the rarest, come to the driver.
        most = counts.orderBy(F.desc("n"), "value").limit(CLASSES_KEPT).collect()
        least = counts.orderBy("n", "value").limit(1).collect() if s.n_unique > CLASSES_KEPT else []
        out.classes = sorted((r.value, r.n) for r in [*most, *least])
        if len(out.classes) == 2:
            out.positive, out.positive_count = out.classes[-1]
            out.positive_rate = out.positive_count / max(1, s.non_null)
    return out


def predicted(df: DataFrame, stats: dict[str, ColumnStats], target: str) -> list[str]:
    """The target's most frequent classes as text, numbers by size; empty for a numeric target."""
    if task_of(stats[target]) != "classification":
        return []
    found = [r.value for r in class_counts(df, target).orderBy(F.desc("n"), "value").limit(CLASSES_KEPT).collect()]
    return sorted(found, key=float) if stats[target].kind == NUMERIC else sorted(found)


def eligible(stats: dict[str, ColumnStats], target: str | None) -> list[str]:
    return [n for n, s in stats.items() if n != target and not s.is_constant and (s.kind == NUMERIC or (s.kind in (TEXT, BOOL) and s.n_unique <= FEATURE_LEVELS))]


def sample_frame(df: DataFrame, stats: dict[str, ColumnStats], target: str, most: int = TARGET_SAMPLE, stratify: bool = True) -> tuple[pd.DataFrame, bool]:
    """A bounded labelled sample with columns as numbers, in hash order, and whether the target is classes."""
    names = eligible(stats, target)
    task = task_of(stats[target])
    n_classes = stats[target].n_unique if task == "classification" and stratify else None
    rows = target_sample(df.select(*[col(n) for n in dict.fromkeys([*names, target])]), target, most, n_classes)
    wide = rows.select(*[(number(n) if stats[n].kind == NUMERIC and (n != target or task == "regression") else as_text(df.schema[n])).alias(f"c{i}") for i, n in enumerate([*names, target])])
    # Bounded by `most` rows.
    pdf = wide.toPandas()
    out = {}
    for i, n in enumerate([*names, target]):
        v = pdf[f"c{i}"]
        numeric_column = stats[n].kind == NUMERIC and (n != target or task == "regression")
        if n == target and task == "classification" and stats[n].kind == NUMERIC:
            v = v.astype(float)
            out[n] = codes(v)
        else:
            out[n] = v.astype(float) if numeric_column else codes(v)
    order = np.random.default_rng(42).permutation(len(pdf))
    return pd.DataFrame(out).iloc[order].reset_index(drop=True), task == "classification"


def information_frame(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], target: str, classification: bool) -> DataFrame:
    """(feature, mutual_info) over all rows that have feature and target, where one of the two is classes."""
    if classification:
        # As number: 1 and 1.0 are one class, and NaN is none.
        y = number(target) + F.lit(0.0) if stats[target].kind == NUMERIC else as_text(df.schema[target])
        numbers, levels = ([n for n in names if (stats[n].kind == NUMERIC) == k] for k in (True, False))
        found = [(numbers, number_information(df, [(number(n), y) for n in numbers])), (levels, level_information(df, [(as_text(df.schema[n]), y) for n in levels]))]
    else:
        found = [(names, number_information(df, [(number(target), as_text(df.schema[n])) for n in names]))]
    out = df.sparkSession.createDataFrame([], "feature string, mutual_info double")
    for own, rows in found:
        if own:
            named = F.element_at(F.array(*map(F.lit, own)), F.col("c") + 1).alias("feature")
            out = out.unionByName(rows.where(F.col("n") >= SUPPORT).select(named, "mutual_info"))
    return out


def sampled_information_frame(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], target: str, sample: pd.DataFrame, classification: bool, bootstrap: int = 0) -> DataFrame:
    """(feature, sampled_info, mi_low, mi_high) over the shared sample: of the named features, and the bootstraps of all; each of them is a task's row."""
    spark = df.sparkSession
    asked = [(n, 0) for n in names] + [(n, k) for n in sample.columns if n != target for k in range(1, bootstrap + 1)]
    if not asked or len(sample) < SUPPORT:
        return spark.createDataFrame([], "feature string, sampled_info double, mi_low double, mi_high double")
    # Bounded by the sample's size.
    shared = spark.sparkContext.broadcast(sample)
    is_number = {n: stats[n].kind == NUMERIC for n in sample.columns}

    def run(batches):
        for batch in batches:
            rows = []
            for n, replicate in zip(batch.feature, batch.replicate):
                x, y = shared.value[n].to_numpy(), shared.value[target].to_numpy()
                ok = ~(np.isnan(x) | np.isnan(y))
                x, y = x[ok], y[ok]
                if len(x) < (50 if replicate else SUPPORT):
                    continue
                if replicate:
                    at = np.random.default_rng(replicate).integers(0, len(x), len(x))
                    x, y = x[at], y[at]
                rows.append((n, replicate, information(x, y, not is_number[n], classification)))
            yield pd.DataFrame(rows, columns=["feature", "replicate", "info"])

    found = spark.createDataFrame(asked, "feature string, replicate int").repartition(min(len(asked), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "feature string, replicate int, info double")
    again = F.when(F.col("replicate") > 0, F.col("info"))
    return found.groupBy("feature").agg(F.max(F.when(F.col("replicate") == 0, F.col("info"))).alias("sampled_info"), F.percentile(again, 0.025).alias("mi_low"), F.percentile(again, 0.975).alias("mi_high"))


def order_frame(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], target: str, classes: list[str]) -> DataFrame:
    """(feature, spearman, auc, auc_lift) of numbers over all rows: against the greater of two classes, or a numeric target."""
    spark = df.sparkSession
    numbers = [n for n in names if stats[n].kind == NUMERIC]
    classification = task_of(stats[target]) == "classification"
    if not numbers or (classification and len(classes) != 2):
        return spark.createDataFrame([], "feature string, spearman double, auc double, auc_lift double")
    values = [number(n) for n in numbers]
    text = as_text(df.schema[target])
    y = F.when(text.isNotNull(), (text == F.lit(classes[-1])).cast("double")) if classification else number(target)
    # Every row with one of the two classes has a side, so one sort of the values serves ranks and areas.
    numbered = sided(df, values, text == F.lit(classes[-1])) if classification else None
    rho = rank_correlations(df, values, y, numbered).select("c", F.col("rho").alias("spearman"))
    named = F.element_at(F.array(*map(F.lit, numbers)), F.col("c") + 1).alias("feature")
    if not classification:
        return rho.select(named, "spearman", *[F.lit(None).cast("double").alias(c) for c in ("auc", "auc_lift")])
    area = auc_of(numbered)
    # One row a feature.
    return area.join(F.broadcast(rho), "c", "left").select(named, "spearman", "auc", F.col("lift").alias("auc_lift"))


def signal_frame(df: DataFrame, stats: dict[str, ColumnStats], target: str, sample: pd.DataFrame | None = None, bootstrap: int = 0, seeds: int = 1) -> DataFrame:
    """A row a feature with at least 30 rows that have it and the target: n, pps with its bootstraps, rank correlation, AUC and
    mutual information over all rows. Only the information's bootstraps, and that of two numbers, see a sample (drawn where none is given)."""
    names = eligible(stats, target)
    classification = task_of(stats[target]) == "classification"
    classes = predicted(df, stats, target)
    power = power_frame(df, stats, names, target, classification, classes, seeds=seeds, replicates=bootstrap).where(F.col("n") >= SUPPORT)
    sampled = [n for n in names if not classification and stats[n].kind == NUMERIC]
    info = information_frame(df, stats, [n for n in names if n not in sampled], target, classification)
    # One row a feature each.
    out = power.join(F.broadcast(order_frame(df, stats, names, target, classes)), "feature", "left").join(F.broadcast(info), "feature", "left")
    mutual_info, low, high = F.col("mutual_info"), *[F.lit(None).cast("double").alias(c) for c in ("mi_low", "mi_high")]
    if sampled or bootstrap:
        sample = sample_frame(df, stats, target)[0] if sample is None else sample
        out = out.join(F.broadcast(sampled_information_frame(df, stats, sampled, target, sample, classification, bootstrap)), "feature", "left")
        mutual_info, low, high = F.coalesce("mutual_info", "sampled_info").alias("mutual_info"), F.col("mi_low"), F.col("mi_high")
    return out.select("feature", "n", "pps", mutual_info, "spearman", "auc", "auc_lift", "positive_count", "auc_low", "auc_high", low, high, "pps_mean", "pps_cov")


def target_signals(df: DataFrame, stats: dict[str, ColumnStats], target: str, most: int = TARGET_SAMPLE, stratify: bool = True, permutation: bool = True, bootstrap: int = 0, seeds: int = 1) -> list[TargetSignal]:
    sample, classification = sample_frame(df, stats, target, most, stratify)
    out = []
    for r in signal_frame(df, stats, target, sample, bootstrap, seeds).collect():
        v = {k: (None if x is None or x != x else x) for k, x in r.asDict().items()}
        pair = lambda a, b, v=v: None if v[a] is None else (v[a], v[b])
        out.append(
            TargetSignal(
                v["feature"], v["pps"] or 0.0, v["mutual_info"], v["spearman"], v["auc"], v["auc_lift"], None, int(v["n"]), None if v["positive_count"] is None else int(v["positive_count"]), pair("auc_low", "auc_high"), pair("mi_low", "mi_high"), v["pps_mean"], v["pps_cov"]
            )
        )
    if permutation and out:
        got = permutation_importance(df.sparkSession, sample, target, classification)
        for s in out:
            s.permutation = got.get(s.feature)
    return ranked(out)


def ranked(signals: list[TargetSignal]) -> list[TargetSignal]:
    """By predictive power, or by the best score where no power says anything; marks leak suspects."""
    by = (lambda s: s.pps) if max((s.pps for s in signals), default=0) >= WEAK_SIGNAL else (lambda s: s.best_score)
    signals = sorted(signals, key=lambda s: (-by(s), s.feature))
    for i, s in enumerate(signals):
        after = signals[i + 1].pps if i + 1 < len(signals) else 0.0
        s.leak_suspect = s.pps >= LEAK or (s.pps >= LEAK_BESIDE and s.pps >= 2 * after)
    return signals
