"""What the renderers share: choices that carry meaning, not layout."""

from __future__ import annotations

from itertools import chain, islice
from typing import Any

from ..functions.kinds import NUMERIC, TEXT
from ..operators.rules import Finding, severity_counts

BLOCKS = "▁▂▃▄▅▆▇█"


def health(profile: Any) -> tuple[int, str]:
    """A score from 0 to 100 and a word for it."""
    n = severity_counts(profile.findings)
    score = max(0, 100 - 15 * n["critical"] - 5 * n["warning"] - n["info"])
    if n["critical"] or score < 40:
        return score, "critical"
    if n["warning"] > 2 or score < 70:
        return score, "fair"
    return score, "good" if n["warning"] or n["info"] > 4 else "clean"


def null_share(profile: Any) -> float:
    cells = sum(s.n for s in profile.columns.values())
    return sum(s.n_null for s in profile.columns.values()) / cells if cells else 0.0


def verdict_cards(found: list[Finding]) -> list[Finding]:
    """The first finding of each severity."""
    first: dict[str, Finding] = {}
    for f in found:
        first.setdefault(f.severity, f)
    return [first[s] for s in ("critical", "warning", "info") if s in first]


def shown_findings(found: list[Finding], most: int = 12) -> list[Finding]:
    """All critical ones and warnings, then infos as far as `most` goes."""
    loud = [f for f in found if f.severity != "info"]
    return loud + [f for f in found if f.severity == "info"][: max(0, most - len(loud))]


#: Columns of a terminal's table, widths of its shapes, and features of a heat map.
COLUMNS, WIDTH, HEAT = 30, 16, 60


def shown_columns(profile: Any, most: int = COLUMNS) -> list[str]:
    """Columns of the summary, what matters first: those of the leading findings, the target, the leading
    signals and the shortlist; then the others in the table's order."""
    leading = chain(
        (c for f in profile.findings[:20] for c in f.columns),
        [profile.target] if profile.target else [],
        (s.feature for s in profile.target_signals[:10]),
        (e.feature for e in (profile.clusters.shortlist[:10] if profile.clusters else [])),
        profile.columns,
    )
    return list(islice(dict.fromkeys(n for n in leading if n in profile.columns), most))


def heat(profile: Any, measure: str, most: int = HEAT) -> tuple[list[str], dict[frozenset[str], float]]:
    """(features, figure of each pair that has it) of one measure, `pearson` or `mutual_info`.

    Numbers that vary, all of them under the cap; else those of the strongest pairs, filled up to it.
    """
    numbers = [n for n, s in profile.columns.items() if s.kind == NUMERIC and not s.is_constant]
    figures = {frozenset((p.a, p.b)): getattr(p, measure) for p in profile.correlations if getattr(p, measure) is not None}
    if len(numbers) < 2 or not figures:
        return [], {}
    if len(numbers) > most:
        paired = (n for p in profile.correlations for n in (p.a, p.b) if n in numbers)
        numbers = list(islice(dict.fromkeys(chain(paired, numbers)), most))
    kept = frozenset(numbers)
    return numbers, {k: v for k, v in figures.items() if k <= kept}


def drilldown(profile: Any) -> list[dict[str, Any]]:
    """The first 12 of the shortlist, each with up to five pairs of score 0.3 and more."""
    out = []
    for e in (profile.clusters.shortlist if profile.clusters else [])[:12]:
        pairs = [(p.b if p.a == e.feature else p.a, p.score) for p in profile.correlations if e.feature in (p.a, p.b) and p.score >= 0.3]
        out.append({"entry": e, "stats": profile.columns.get(e.feature), "pairs": pairs[:5]})
    return out


def sparkline(counts: list[float], width: int = WIDTH) -> str:
    """One mark a count, or a mean of neighbours where there are more than the width; a blank for nothing."""
    if len(counts) > width:
        edges = [len(counts) * k // width for k in range(width + 1)]
        counts = [sum(counts[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]
    most = max(counts, default=0)
    if most <= 0:
        return BLOCKS[0] * len(counts)
    return "".join(BLOCKS[round(c / most * (len(BLOCKS) - 1))] if c > 0 else " " for c in counts)


def summary(s: Any) -> str:
    """A column in a few words: moments of a number, span of a time, lengths of a text."""
    if s.kind == NUMERIC and s.mean is not None:
        said = [f"mean {figure(s.mean)}", f"std {figure(s.std)}", f"{figure(s.min)} to {figure(s.max)}"]
        said += [f"skew {s.skew:+.2f}"] if s.skew is not None and abs(s.skew) > 1 else []
        return ", ".join(said + ([f"{s.n_outliers_iqr:,} outliers"] if s.n_outliers_iqr else []))
    if s.ts_min is not None:
        return f"{s.ts_min} to {s.ts_max}"
    if s.is_constant:
        return "constant"
    return f"{s.avg_len:.0f} characters, {s.max_len} at most" if s.avg_len is not None and s.kind == TEXT else ""


def shape(s: Any) -> str:
    """A number's or time's sparkline; the first levels of a category with their rows."""
    if s.kind == NUMERIC or s.temporal_buckets:
        return sparkline([h[-1] for h in (s.histogram or s.temporal_buckets)])
    short = lambda v: v if len(v) <= 14 else v[:13] + "…"
    return "  ".join(f"{short(v)} ({n:,})" for v, n in s.top_values[:3])


def figure(x: float | None) -> str:
    return "-" if x is None else f"{x:,.4g}" if isinstance(x, float) else f"{x:,}"
