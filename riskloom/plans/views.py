"""What can be asked of a finished profile: its parts as records or frames, and the columns that a question picks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.rules import Finding
from ..session import session
from .serde import plain


@dataclass(frozen=True)
class View:
    """A part of a profile: its rows, the schema of its frame, and the properties that records show beside stored fields."""

    rows: Callable[[Any], Iterable[Any]]
    schema: str
    derived: tuple[str, ...] = ()


VIEWS = {
    "findings": View(lambda p: p.findings, "severity string, category string, kind string, title string, detail string, columns array<string>, score double"),
    "columns": View(
        lambda p: p.columns.values(),
        "name string, dtype string, kind string, n long, n_null long, n_unique long, mean double, std double, min double, p25 double, p50 double, p75 double, max double, skew double, n_outliers_iqr long, avg_len double, max_len long",
        ("null_rate", "unique_rate"),
    ),
    "signals": View(lambda p: p.target_signals, "feature string, pps double, mutual_info double, spearman double, auc double, auc_lift double, permutation double, n long, confidence string, leak_suspect boolean", ("confidence",)),
    "shortlist": View(lambda p: p.clusters.shortlist if p.clusters else (), "feature string, score double, method string, cluster int, weak boolean, redundant array<string>"),
    "correlations": View(lambda p: p.correlations, "a string, b string, pearson double, mutual_info double, score double", ("score",)),
}


def records(profile: Any, name: str) -> list[dict[str, Any]]:
    view = VIEWS[name]
    return [plain(r) | {k: getattr(r, k) for k in view.derived} for r in view.rows(profile)]


def frame(profile: Any, name: str, spark: SparkSession | None = None) -> DataFrame:
    spark = spark or session()
    schema = T.StructType.fromDDL(VIEWS[name].schema)
    typed = lambda x, t: float(x) if x is not None and isinstance(t, T.DoubleType) else x
    return spark.createDataFrame([tuple(typed(r[f.name], f.dataType) for f in schema) for r in records(profile, name)], schema)


def chosen(found: Iterable[Finding], limit: int | None, **wanted: str | Iterable[str] | None) -> list[Finding]:
    """The first findings whose fields have a wanted value (one or several); None takes any."""
    sets = {k: {v} if isinstance(v, str) else set(v) for k, v in wanted.items() if v is not None}
    return [f for f in found if all(getattr(f, k) in v for k, v in sets.items())][:limit]


def named(found: Iterable[Finding], spare: Iterable[str | None], first: Iterable[str] = ()) -> list[str]:
    """Columns of findings in their order, each once, after those given first; spared ones left out."""
    order = dict.fromkeys([*first, *(c for f in found for c in f.columns)])
    return [c for c in order if c not in set(spare)]


def suspects(profile: Any) -> list[str]:
    """Features that know the outcome: by their signal, then by what the rules found."""
    strong = (s.feature for s in profile.target_signals if s.leak_suspect)
    return named(chosen(profile.findings, None, category="leakage", severity="critical"), (profile.target, profile.time_column), strong)


def useless(profile: Any) -> list[str]:
    """Columns that quality or suspicion speaks against with more than a remark."""
    return named(chosen(profile.findings, None, category=("quality", "suspicious"), severity=("critical", "warning")), (profile.target,))
