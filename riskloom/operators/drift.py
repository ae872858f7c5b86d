"""Two profiles side by side: what differs in schema, features and target."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.kinds import BOOL, NUMERIC, TEXT
from .columns import ColumnStats
from .rules import Finding, ranked

MASS, COVERAGE, UNIQUE = 30, 0.25, 0.5
#: (warning, info) thresholds.
KS, PSI, JS, NULLS, CHI2_P = (0.20, 0.10), (0.25, 0.10), (0.25, 0.10), 0.05, 0.05


@dataclass
class SchemaDiff:
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    type_changed: list[tuple[str, str, str]] = field(default_factory=list)
    shared: list[str] = field(default_factory=list)


@dataclass
class FeatureDrift:
    name: str
    kind: str
    null_delta: float = 0.0
    null_rate_a: float = 0.0
    null_rate_b: float = 0.0
    mean_a: float | None = None
    mean_b: float | None = None
    ks: float | None = None
    ks_p: float | None = None
    wasserstein: float | None = None
    psi: float | None = None
    chi2: float | None = None
    chi2_p: float | None = None
    js: float | None = None

    @property
    def drift_score(self) -> float:
        parts = ((self.ks, 0.5), (self.psi, 0.5), (self.js, 0.5), (abs(self.null_delta), 0.25))
        return max(min(1.0, v / by) for v, by in parts if v is not None)

    @property
    def severity(self) -> str:
        over = lambda v, t: v is not None and v >= t
        if over(self.ks, KS[0]) or over(self.psi, PSI[0]) or over(self.js, JS[0]) or abs(self.null_delta) >= NULLS:
            return "warning"
        if over(self.ks, KS[1]) or over(self.psi, PSI[1]) or over(self.js, JS[1]) or (self.chi2_p is not None and self.chi2_p < CHI2_P):
            return "info"
        return "none"


@dataclass
class TargetDelta:
    name: str
    kind: str
    before: float | None = None
    after: float | None = None
    delta: float | None = None


@dataclass
class CompareReport:
    name_a: str
    name_b: str
    rows_a: int
    rows_b: int
    schema: SchemaDiff
    features: list[FeatureDrift] = field(default_factory=list)
    target: TargetDelta | None = None
    findings: list[Finding] = field(default_factory=list)

    def top(self, n: int = 10) -> list[FeatureDrift]:
        return self.features[:n]

    def to_dict(self) -> dict[str, Any]:
        out = asdict(self)
        for d, f in zip(out["features"], self.features):
            d |= {"drift_score": f.drift_score, "severity": f.severity}
        return out

    def save(self, path: str | Path) -> Path:
        from ..plans.serde import plain, write_json

        return write_json(plain(self.to_dict()), path)


def schema_diff(a: dict[str, ColumnStats], b: dict[str, ColumnStats]) -> SchemaDiff:
    shared = sorted(a.keys() & b.keys())
    return SchemaDiff(sorted(b.keys() - a.keys()), sorted(a.keys() - b.keys()), [(n, a[n].kind, b[n].kind) for n in shared if a[n].kind != b[n].kind], shared)


def rebin(h: list[tuple[float, float, int]], grid: np.ndarray) -> np.ndarray:
    """Mass of a histogram on another grid, in proportion to overlap. Bins of no width have none."""
    out = np.zeros(len(grid) - 1)
    for low, high, n in h:
        if high > low:
            out += n * np.maximum(0, np.minimum(grid[1:], high) - np.maximum(grid[:-1], low)) / (high - low)
    return out


def psi(a: np.ndarray, b: np.ndarray) -> float:
    """Population stability of two shares; smoothed by a bin's share, 0 below three bins."""
    if len(a) < 3:
        return 0.0
    e = 1 / len(a)
    p, q = (a + e) / (a + e).sum(), (b + e) / (b + e).sum()
    return float(((q - p) * np.log(q / p)).sum())


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Divergence in nats."""
    m = (p + q) / 2
    half = lambda x: float((x[x > 0] * np.log(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (half(p) + half(q)) / 2)


def chi_square(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    """(statistic, p) of a two-row table; corrected for continuity where it is two by two."""
    table = np.stack([a, b]).astype(float)
    table = table[:, table.sum(0) > 0]
    if table.shape[1] < 2 or (table.sum(1) == 0).any():
        return None
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    gap = np.abs(table - expected)
    if table.shape[1] == 2:
        gap = np.maximum(gap - 0.5, 0)
    statistic = float((gap**2 / expected).sum())
    return statistic, numeric.chi2_p_value(statistic, table.shape[1] - 1)


def _numeric_drift(d: FeatureDrift, a: ColumnStats, b: ColumnStats) -> None:
    if not a.histogram or not b.histogram:
        return
    low, high = min(a.histogram[0][0], b.histogram[0][0]), max(a.histogram[-1][1], b.histogram[-1][1])
    if not high > low:
        return
    grid = np.linspace(low, high, max(len(a.histogram), len(b.histogram)) + 1)
    p, q = rebin(a.histogram, grid), rebin(b.histogram, grid)
    if p.sum() < MASS or q.sum() < MASS:
        return
    n = p.sum() * q.sum() / (p.sum() + q.sum())
    p, q = p / p.sum(), q / q.sum()
    gap = np.abs(np.cumsum(p) - np.cumsum(q))
    d.ks, d.psi = float(gap.max()), psi(p, q)
    d.ks_p = numeric.ks_p_value(d.ks, n)
    centres = (grid[1:] + grid[:-1]) / 2
    d.wasserstein = float((gap[:-1] * np.diff(centres)).sum())


def _categorical_drift(d: FeatureDrift, a: ColumnStats, b: ColumnStats) -> None:
    cover = min(sum(n for _, n in s.top_values) / s.non_null if s.non_null else 0 for s in (a, b))
    if a.unique_rate > UNIQUE or b.unique_rate > UNIQUE or cover < COVERAGE:
        return
    x, y = dict(a.top_values), dict(b.top_values)
    levels = sorted(x.keys() | y.keys())
    p, q = (np.array([t.get(k, 0) for k in levels], float) for t in (x, y))
    if not p.sum() or not q.sum():
        return
    if got := chi_square(p, q):
        d.chi2, d.chi2_p = got
    d.js = jensen_shannon(p / p.sum(), q / q.sum())


#: What drift between two kinds is measured as; the rest has only its missing values.
MEASURED = {(NUMERIC, NUMERIC): (NUMERIC, _numeric_drift), **{(x, y): (TEXT if x != y else x, _categorical_drift) for x in (TEXT, BOOL) for y in (TEXT, BOOL)}}


def feature_drift(a: ColumnStats, b: ColumnStats) -> FeatureDrift:
    """Texts and flags are compared by their values, also with one another."""
    kind, measure = MEASURED.get((a.kind, b.kind), (a.kind if a.kind == b.kind else "other", None))
    d = FeatureDrift(a.name, kind, b.null_rate - a.null_rate, a.null_rate, b.null_rate, a.mean, b.mean)
    if measure:
        measure(d, a, b)
    return d


def target_delta(a: Any, b: Any) -> TargetDelta | None:
    """Change of the target of two profiles; None unless both have the same."""
    if a.target is None or a.target != b.target:
        return None
    if a.target_summary is None or b.target_summary is None:
        return TargetDelta(a.target, "missing")
    x, y = a.target_summary, b.target_summary
    if x.positive_rate is not None and y.positive_rate is not None:
        return TargetDelta(a.target, "binary", x.positive_rate, y.positive_rate, y.positive_rate - x.positive_rate)
    if x.classes and y.classes:
        share = lambda t: {k: n / sum(m for _, m in t.classes) for k, n in t.classes}
        p, q = share(x), share(y)
        return TargetDelta(a.target, "multiclass", delta=max(abs(p.get(k, 0) - q.get(k, 0)) for k in p | q))
    if x.mean is not None and y.mean is not None:
        return TargetDelta(a.target, "regression", x.mean, y.mean, y.mean - x.mean)
    return TargetDelta(a.target, "missing")


def compare_profiles(a: Any, b: Any) -> CompareReport:
    schema = schema_diff(a.columns, b.columns)
    features = sorted((feature_drift(a.columns[n], b.columns[n]) for n in schema.shared), key=lambda d: -d.drift_score)
    out = CompareReport(a.source_name, b.source_name, a.n_rows, b.n_rows, schema, features, target_delta(a, b))
    found = [Finding("warning", "schema", f"{n} was removed", "", [n], 1.0, "schema_removed") for n in schema.removed]
    found += [Finding("info", "schema", f"{n} was added", "", [n], 0.5, "schema_added") for n in schema.added]
    found += [Finding("warning", "schema", f"{n} changed from {x} to {y}", "", [n], 1.0, "schema_type_change") for n, x, y in schema.type_changed]
    for d in features:
        if d.severity != "none":
            figures = ", ".join(f"{k} {v:.2f}" for k, v in (("KS", d.ks), ("PSI", d.psi), ("JS", d.js), ("nulls", d.null_delta)) if v)
            found.append(Finding(d.severity, "drift", f"{d.name} drifted", figures, [d.name], d.drift_score, "feature_drift"))
    if (t := out.target) and t.kind != "missing":
        size = abs(t.delta or 0.0) if t.kind != "regression" else abs(t.delta or 0.0) / (abs(t.before) or 1.0)
        found.append(Finding("warning" if size >= 0.05 else "info", "target", f"target {t.name} changed by {t.delta or 0:.3f}", "", [t.name], min(1.0, size), "target_drift"))
    out.findings = ranked(found)
    return out


# ---- the same figures over rows, as relations ----


def shares(df: DataFrame, value: Column, side: Column) -> DataFrame:
    """(v, p, q): shares of each value where side is false and where it is true."""
    counts = df.select(value.alias("v"), side.alias("s")).where("v is not null and s is not null").groupBy("v").agg(F.sum((~F.col("s")).cast("double")).alias("a"), F.sum(F.col("s").cast("double")).alias("b"))
    # One row.
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return counts.crossJoin(F.broadcast(total)).select("v", "a", "b", (F.col("a") / F.nullif(F.col("ta"), F.lit(0.0))).alias("p"), (F.col("b") / F.nullif(F.col("tb"), F.lit(0.0))).alias("q"), "ta", "tb")


def binned_drift_frame(df: DataFrame, value: Column, side: Column, low: float, high: float, bins: int) -> DataFrame:
    """One row (ks, psi, wasserstein) of a number between two sides, on a common grid of bins."""
    from pyspark.sql.window import Window

    from .columns import bin_of

    s = shares(df, bin_of(value, low, high, bins), side).select("v", "p", "q")
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("v"))
    full = grid.join(s, "v", "left").select("v", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    # The window runs over the bins, not over rows.
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    e = 1 / bins
    sp, sq = (F.col("p") + e) / F.lit(1 + bins * e), (F.col("q") + e) / F.lit(1 + bins * e)
    cum = full.select("v", F.abs(F.sum("p").over(w) - F.sum("q").over(w)).alias("gap"), ((sq - sp) * F.log(sq / sp)).alias("psi"))
    width = (high - low) / bins
    return cum.agg(F.max("gap").alias("ks"), F.sum("psi").alias("psi"), (F.sum(F.when(F.col("v") < bins - 1, F.col("gap")).otherwise(0.0)) * F.lit(width)).alias("wasserstein"))


__all__ = ["CompareReport", "FeatureDrift", "SchemaDiff", "TargetDelta", "compare_profiles"]
