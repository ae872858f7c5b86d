"""Findings: what the figures mean for a model, ranked."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.kinds import BOOL, NUMERIC, TEXT
from .association import Pair
from .columns import ColumnStats
from .roles import looks_like_id
from .target import TargetSignal, TargetSummary
from .temporal import TemporalReport

RANK = {"critical": 0, "warning": 1, "info": 2}
# Texts that stand for a missing value, and the starts of dates.
SENTINELS = frozenset({"?", "NA", "N/A", "n/a", "nan", "NaN"})
DATE_START = re.compile(r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}")

WHY = {
    "leakage": "A feature that knows the outcome makes offline scores worthless in production.",
    "quality": "What is missing or mistyped has to be settled before training.",
    "suspicious": "Such a column seldom carries signal and often carries identity.",
    "distribution": "The shape decides which transform and which summary can be trusted.",
    "correlation": "Features that say the same blur importance and can hide a leak.",
    "target": "The target decides whether any metric is stable.",
    "temporal": "What changes over time separates training from use.",
}


@dataclass
class Finding:
    severity: str
    category: str
    title: str
    detail: str = ""
    columns: list[str] = field(default_factory=list)
    score: float = 0.0
    kind: str = ""

    @property
    def rank(self) -> int:
        return RANK[self.severity]

    @property
    def why(self) -> str:
        return WHY.get(self.category, "This changes how the table should be prepared.")


def _pct(x: float) -> str:
    return f"{x:.1%}"


def column_findings(stats: dict[str, ColumnStats], target: str | None = None) -> list[Finding]:
    return [f for s in stats.values() for f in _of_column(s, target)]


def _of_column(s: ColumnStats, target: str | None) -> Iterable[Finding]:
    def say(severity: str, category: str, kind: str, score: float, title: str, detail: str = "") -> Finding:
        return Finding(severity, category, title, detail, [s.name], float(score), kind)

    feature = s.name != target
    present = s.non_null
    if s.null_rate >= 1:
        yield say("critical", "quality", "all_null", 1, f"{s.name} has no values")
        return
    if s.is_constant:
        if feature:
            yield say("warning", "suspicious", "constant", 1, f"{s.name} has one value only")
        return
    if feature and s.is_near_constant:
        yield say("warning", "suspicious", "near_constant", s.top_share, f"{s.name} is nearly constant", f"{_pct(s.top_share)} of values are {s.top_values[0][0]}")
    if s.null_rate > 0.5:
        yield say("critical" if s.null_rate > 0.9 else "warning", "quality", "high_nulls", s.null_rate, f"{s.name} is mostly missing", f"{_pct(s.null_rate)} missing")
    elif s.null_rate > 0.1:
        yield say("info", "quality", "some_nulls", s.null_rate, f"{s.name} has missing values", f"{_pct(s.null_rate)} missing")
    if s.n_unique == present and present > 50 and looks_like_id(s.name):
        yield say("warning", "suspicious", "identifier_shape", 0.9, f"{s.name} looks like an identifier", "every value is unique")
    if s.kind == NUMERIC and feature:
        if s.skew is not None and abs(s.skew) > 3:
            yield say("info", "distribution", "heavy_skew", min(abs(s.skew) / 10, 1.0), f"{s.name} is heavily skewed", f"skewness {s.skew:.1f}")
        rate = (s.n_outliers_iqr or 0) / present if present else 0
        if rate > 0.01:
            yield say("info", "distribution", "outliers", rate, f"{s.name} has outliers", f"{_pct(rate)} beyond the quartile fences")
        # Both values are judged by their range, as one top value can't show both.
        if s.n_unique <= 2 and s.min is not None and s.min in (0, 1) and s.max in (0, 1):
            yield say("info", "quality", "bool_as_int", 0.4, f"{s.name} is a flag stored as a number")
    if s.kind == TEXT:
        lead = [v for v, _ in s.top_values]
        if marks := [v for v in lead if v in SENTINELS]:
            first = lead[0] in SENTINELS
            yield say("warning" if first else "info", "quality", "encoded_nulls", 0.85 if first else 0.6, f"{s.name} writes missing values as text", f"found {', '.join(marks)}")
        if s.n_unique > 0.5 * present and s.n_unique > 50:
            yield say("info", "suspicious", "high_cardinality_text", 0.7, f"{s.name} has very many texts", f"{s.n_unique} different")
        if feature and (s.avg_len or 0) > 32 and s.unique_rate > 0.8:
            yield say("info", "suspicious", "free_text", 0.6, f"{s.name} is free text", f"{s.avg_len:.0f} characters on average")
        dated = sum(bool(DATE_START.match(v.strip())) for v in lead)
        if feature and lead and dated >= 0.8 * len(lead):
            yield say("warning", "quality", "date_as_string", 0.75, f"{s.name} holds dates as text")
    if target and feature and s.kind in (TEXT, BOOL) and s.n_unique > 0.3 * present and s.n_unique > 30:
        yield say("warning", "quality", "high_cardinality_cat", 0.6, f"{s.name} has too many levels to encode plainly", f"{s.n_unique} levels")


def target_findings(t: TargetSummary) -> list[Finding]:
    out = []

    def say(severity: str, kind: str, score: float, title: str, detail: str = "") -> None:
        out.append(Finding(severity, "target", title, detail, [t.name], float(score), kind))

    if t.task == "classification":
        if len(t.classes) <= 1:
            say("critical", "target_single_class", 1, f"target {t.name} has one class")
            return out
        if t.positive_rate is not None:
            rare = t.positive_count < 100 or t.positive_rate < 0.01
            say("warning" if rare else "info", "target_imbalance", min(1.0, 1 - t.positive_rate), f"target {t.name} is {_pct(t.positive_rate)} positive", f"{t.positive_count} rows of {t.positive}")
        elif min(n for _, n in t.classes) < 30:
            say("warning", "target_low_support", 0.8, f"target {t.name} has classes with few rows")
    if t.n_missing:
        rate = t.n_missing / t.n
        say("warning" if rate > 0.1 else "info", "target_missing_labels", rate, f"target {t.name} misses labels", f"{_pct(rate)} of rows")
    return out


def pair_findings(pairs: list[Pair]) -> list[Finding]:
    out = []
    for p in [p for p in pairs if p.score >= 0.7][:15]:
        r = abs(p.pearson or 0.0)
        if r > 0.95:
            out.append(Finding("warning", "correlation", f"{p.a} and {p.b} are nearly the same", f"correlation {p.pearson:.2f}", [p.a, p.b], r, "multicollinearity"))
        elif p.is_nonlinear:
            out.append(Finding("info", "correlation", f"{p.a} and {p.b} depend on each other, not linearly", "", [p.a, p.b], p.mutual_info, "nonlinear_association"))
        elif p.score >= 0.8:
            out.append(Finding("info", "correlation", f"{p.a} and {p.b} are strongly related", "", [p.a, p.b], p.score, "strong_association"))
    return out


def signal_findings(signals: list[TargetSignal], target: str) -> list[Finding]:
    out = []
    for s in signals[:10]:
        if s.leak_suspect:
            out.append(Finding("critical", "leakage", f"{s.feature} predicts {target} too well", f"predictive power {s.pps:.2f}", [s.feature], s.pps, "target_pps_leak"))
        elif s.pps >= 0.3:
            out.append(Finding("info", "target", f"{s.feature} predicts {target}", f"predictive power {s.pps:.2f}", [s.feature], s.pps, "target_signal"))
        if (s.pps_cov or 0) > 0.30 and s.pps >= 0.05:
            out.append(Finding("info", "target", f"the power of {s.feature} is unstable", f"varies by {_pct(s.pps_cov)}", [s.feature], 0.4, "pps_unstable"))
    return out


def temporal_findings(report: TemporalReport, target: str | None) -> list[Finding]:
    out = []
    if report.insufficient:
        out.append(Finding("info", "temporal", "time wasn't analysed", report.insufficient, [report.time_column], 0.0, "temporal_skipped"))
    for s in report.signals:
        if s.severity == "none":
            continue
        score = s.gap or s.drift or 0.0
        if s.leakage_kind in ("random_cv", "post_event"):
            detail = f"power {s.pps_random or 0:.2f} in a random split, {s.pps_time or 0:.2f} over time"
            out.append(Finding(s.severity, "leakage", f"{s.feature} leaks through time", detail, [s.feature], score, "temporal_leak"))
            continue
        kind = "time_monotonic" if (s.monotonicity or 0) >= 0.95 else "feature_drift" if (s.drift or 0) >= 0.3 else "temporal_anomaly"
        said = {"time_monotonic": "follows time", "feature_drift": "drifts over time", "temporal_anomaly": "changes over time"}[kind]
        out.append(Finding(s.severity, "temporal", f"{s.feature} {said}", f"drift {s.drift or 0:.2f}", [s.feature], score, kind))
    if target and report.is_target_drifted:
        out.append(Finding("info", "temporal", f"target {target} drifts over time", f"{report.drift_kind}: {report.drift_score:.2f}", [target], min(1.0, report.drift_score), "target_temporal_drift"))
    return out


def ranked(found: Iterable[Finding]) -> list[Finding]:
    """By severity, then falling score; otherwise as found."""
    return sorted(found, key=lambda f: (f.rank, -f.score))


def severity_counts(found: Iterable[Finding]) -> dict[str, int]:
    out = dict.fromkeys(RANK, 0)
    for f in found:
        out[f.severity] += 1
    return out
