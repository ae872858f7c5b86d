"""Roles that column names and shapes suggest."""

from __future__ import annotations

from ..functions.kinds import BOOL, NUMERIC, TEMPORAL, TEXT
from .columns import ColumnStats

# Names of targets in order of preference, and parts of names of times.
TARGET_NAMES = ("target", "label", "y", "outcome", "churn", "churned", "converted", "conversion", "default", "fraud", "is_fraud")
TIME_WORDS = ("date", "time", "created", "event", "snapshot", "as_of")


def looks_like_id(name: str) -> bool:
    low = name.lower()
    return low == "id" or low.endswith("_id") or "uuid" in low


def infer_target(stats: dict[str, ColumnStats]) -> str | None:
    low = {n.lower(): n for n in reversed(list(stats))}
    named = [low[t] for t in TARGET_NAMES if t in low]
    affixed = [n for n in stats if n.lower().endswith("_target") or n.lower().startswith("target_")]
    flags = [n for n, s in stats.items() if n.lower().startswith(("is_", "has_")) and s.n_unique == 2]
    return next(iter([*named, *affixed, *flags]), None)


def infer_time(stats: dict[str, ColumnStats]) -> str | None:
    times = [n for n, s in stats.items() if s.kind == TEMPORAL and s.n_unique >= 10]
    if len(times) == 1:
        return times[0]
    return next((n for n in times if any(w in n.lower() for w in TIME_WORDS)), None)


def infer_excludes(stats: dict[str, ColumnStats], target: str | None = None, time: str | None = None) -> list[str]:
    def out(n: str, s: ColumnStats) -> bool:
        key = looks_like_id(n) and s.unique_rate >= 0.95
        prose = s.kind == TEXT and s.unique_rate >= 0.80 and s.n_unique > 100
        return s.non_null > 50 and (key or prose)

    return [n for n, s in stats.items() if n not in (target, time) and out(n, s)]


def hints(s: ColumnStats) -> list[str]:
    """Short labels of what a column looks like."""
    shapes = {
        "identifier": looks_like_id(s.name),
        "boolean": s.kind == NUMERIC and s.n_unique <= 2,
        "low-card categorical": s.kind in (TEXT, BOOL) and 2 <= s.n_unique <= 20,
        "ordinal candidate target": s.kind == NUMERIC and 2 < s.n_unique <= 20,
        "time column candidate": s.kind == TEMPORAL,
        "high-null": s.null_rate >= 0.5,
    }
    return [label for label, fits in shapes.items() if fits]
