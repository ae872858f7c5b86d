"""Reports as one HTML file without outside parts; charts are inline SVG."""

from __future__ import annotations

from html import escape
from pathlib import Path
from typing import Any

from .views import drilldown, figure, heat, health, null_share, summary, verdict_cards

_STYLE = """body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#222;background:#fff}
table{border-collapse:collapse;margin:.5rem 0}td,th{padding:.2rem .7rem;border-bottom:1px solid #ddd;text-align:left}
.card{border:1px solid #ddd;border-left-width:5px;border-radius:4px;padding:.5rem 1rem;margin:.5rem 0}.critical{border-left-color:#b3261e}.warning{border-left-color:#c77700}.info{border-left-color:#3367a8}
.grid{display:grid;grid-template-columns:repeat(auto-fill,minmax(15rem,1fr));gap:1rem}svg{display:block}small{color:#666}
@media(prefers-color-scheme:dark){body{background:#16181c;color:#e6e6e6}td,th,.card{border-color:#3a3d44}small{color:#9aa0a8}}"""


def _e(x: Any) -> str:
    return escape(str(x))


def _table(head: list[str], rows: list[list[Any]]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{_e(c)}</td>" for c in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{_e(h)}</th>" for h in head) + f"</tr>{body}</table>"


def _bars(values: list[tuple[str, float]], width: int = 240, height: int = 60) -> str:
    most = max((v for _, v in values), default=0) or 1
    step = width / max(1, len(values))
    parts = [f'<rect x="{i * step:.1f}" y="{height - height * v / most:.1f}" width="{max(1.0, step - 1):.1f}" height="{height * v / most:.1f}" fill="#3367a8"><title>{_e(n)}: {v:g}</title></rect>' for i, (n, v) in enumerate(values)]
    return f'<svg width="{width}" height="{height}" role="img">{"".join(parts)}</svg>'


def _column_chart(s: Any) -> str:
    if s.temporal_buckets:
        return _bars(s.temporal_buckets)
    if s.top_values and s.kind != "numeric":
        return _bars(s.top_values)
    return _bars([(f"{a:.4g} to {b:.4g}", n) for a, b, n in s.histogram])


def _heat(profile: Any, measure: str, title: str) -> str:
    """Positive figures in one colour, negative ones in another; a pair without the figure stays empty."""
    names, figures = heat(profile, measure)
    if not names:
        return ""
    cell, left = 18, 150
    parts = [f'<text x="{left - 6}" y="{i * cell + 13}" text-anchor="end" font-size="11" fill="currentColor">{_e(n[:22])}</text>' for i, n in enumerate(names)]
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            v = 1.0 if a == b else figures.get(frozenset((a, b)))
            if v is not None:
                parts.append(f'<rect x="{left + j * cell}" y="{i * cell}" width="{cell - 1}" height="{cell - 1}" fill="{"#3367a8" if v >= 0 else "#b3261e"}" fill-opacity="{min(1.0, abs(v)):.2f}"><title>{_e(a)}, {_e(b)}: {v:.2f}</title></rect>')
    return f'<h3>{_e(title)}</h3><svg width="{left + cell * len(names)}" height="{cell * len(names)}" role="img">{"".join(parts)}</svg>'


def _dumbbells(signals: list[Any], width: int = 420) -> str:
    """Each feature's power over time (hollow) and in a random split (filled), joined by a line."""
    both = [s for s in signals if s.pps_random is not None and s.pps_time is not None][:15]
    if not both:
        return ""
    left, row = 150, 20
    x = lambda v: left + (width - left - 10) * max(0.0, min(1.0, v))
    parts = []
    for i, s in enumerate(both):
        y = i * row + 10
        parts.append(f'<text x="{left - 8}" y="{y + 4}" text-anchor="end" font-size="11" fill="currentColor">{_e(s.feature[:22])}</text><line x1="{x(s.pps_time):.1f}" x2="{x(s.pps_random):.1f}" y1="{y}" y2="{y}" stroke="#999"/>')
        parts.append(f'<circle cx="{x(s.pps_time):.1f}" cy="{y}" r="4" fill="none" stroke="#3367a8"><title>over time {s.pps_time:.2f}</title></circle><circle cx="{x(s.pps_random):.1f}" cy="{y}" r="4" fill="#b3261e"><title>random split {s.pps_random:.2f}</title></circle>')
    return f'<p><small>Filled: power in a random split; hollow: over time.</small></p><svg width="{width}" height="{row * len(both)}" role="img">{"".join(parts)}</svg>'


def _cards(found: list[Any]) -> str:
    return "".join(f'<div class="card {f.severity}"><b>{_e(f.title)}</b> <small>{_e(f.category)}</small><br>{_e(f.detail)} <small>{_e(f.why)}</small></div>' for f in found)


def _page(title: str, *parts: str) -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{_e(title)}</title><style>{_STYLE}</style></head><body>{"".join(p for p in parts if p)}</body></html>'


def profile_html(p: Any) -> str:
    score, word = health(p)
    plan = p.action_plan()
    parts = [f"<h1>{_e(p.source_name)}</h1><p>{p.n_rows:,} rows, {p.n_cols} columns, {null_share(p):.1%} missing. Health {score}: {word}.</p>", "<h2>First</h2>" + _cards(verdict_cards(p.findings)) if p.findings else "", "<h2>Findings</h2>" + _cards(p.findings)]
    if p.target_summary and p.target_summary.classes:
        parts.append(f"<h2>Target {_e(p.target)}</h2>" + _bars(p.target_summary.classes))
    if p.target_signals:
        parts.append("<h2>What predicts it</h2>" + _bars([(s.feature, s.pps) for s in p.target_signals[:20]]) + _table(["feature", "pps", "mi", "auc", "rho", "importance", "confidence", "leak?"], [[s.feature, figure(s.pps), figure(s.mutual_info), figure(s.auc), figure(s.spearman), figure(s.permutation), s.confidence, "yes" if s.leak_suspect else ""] for s in p.target_signals]))
    if p.temporal:
        t = p.temporal
        parts.append(f"<h2>Over {_e(t.time_column)}</h2>" + (f"<p>{_e(t.insufficient)}</p>" if t.insufficient else "") + _table(["feature", "random split", "by time", "drift", "order", "severity", "kind"], [[s.feature, figure(s.pps_random), figure(s.pps_time), figure(s.drift), figure(s.monotonicity), s.severity, s.leakage_kind] for s in t.signals]))
        parts.append(_dumbbells(t.signals))
        values = [(b.label, b.value if b.value is not None else b.n_rows) for b in t.buckets]
        parts.append(_bars(values) + (f"<p>Target drift ({_e(t.drift_kind)}): {figure(t.drift_score)}</p>" if t.drift_kind else ""))
    if p.clusters and p.clusters.clusters:
        parts.append("<h2>Groups of like features</h2>" + _table(["keep", "members", "mean correlation"], [[c.representative, ", ".join(c.members), figure(c.mean_abs_correlation)] for c in p.clusters.clusters]))
    if cards := drilldown(p):
        parts.append('<h2>Shortlist</h2><div class="grid">' + "".join(f"<div><b>{_e(d['entry'].feature)}</b> {figure(d['entry'].score)} <small>{_e(d['entry'].method)}{', weak' if d['entry'].weak else ''}</small>{_column_chart(d['stats']) if d['stats'] else ''}<small>{_e(', '.join(f'{n} {v:.2f}' for n, v in d['pairs']))}</small></div>" for d in cards) + "</div>")
    parts.append("<h2>Pairs</h2>" + _heat(p, "pearson", "Correlation") + _heat(p, "mutual_info", "Mutual information") + _table(["a", "b", "correlation", "mutual information"], [[x.a, x.b, figure(x.pearson), figure(x.mutual_info)] for x in p.correlations[:30]]))
    parts.append("<h2>Plan</h2>" + _table(["", "column", "action", "because"], [[r["bucket"], r["column"], r["action"], r["reason"]] for r in plan.records()]) + f"<p>Split: {_e(plan.split.detail)}. Validation: {_e(plan.cv.detail)}.</p>")
    parts.append('<h2>Columns</h2><div class="grid">' + "".join(f"<div><b>{_e(s.name)}</b> <small>{_e(s.dtype)}, {s.null_rate:.1%} missing, {s.n_unique:,} unique</small>{_column_chart(s)}<small>{_e(summary(s))}</small></div>" for s in p.columns.values()) + "</div>")
    return _page(p.source_name, *parts)


def compare_html(r: Any) -> str:
    shown = [d for d in r.features if d.drift_score > 0][:12]
    rows = [[d.name, d.kind, figure(d.drift_score), figure(d.ks), figure(d.psi), figure(d.js), f"{d.null_delta:+.1%}", d.severity] for d in r.features]
    return _page(
        f"{r.name_a} and {r.name_b}",
        f"<h1>{_e(r.name_a)} and {_e(r.name_b)}</h1><p>{r.rows_a:,} and {r.rows_b:,} rows.</p>",
        "<h2>Findings</h2>" + _cards(r.findings),
        "<h2>Most drift</h2>" + _bars([(d.name, d.drift_score) for d in shown]),
        "<h2>Columns</h2>" + _table(["column", "kind", "drift", "KS", "PSI", "JS", "missing", "severity"], rows),
    )


def write_html(profile: Any, path: str | Path) -> Path:
    Path(path).write_text(profile_html(profile), encoding="utf-8")
    return Path(path)


def write_compare_html(report: Any, path: str | Path) -> Path:
    Path(path).write_text(compare_html(report), encoding="utf-8")
    return Path(path)


def shown(profile: Any) -> Any:
    """Hands the report to a notebook that can draw it and returns the profile; without one, the HTML."""
    page = profile_html(profile)
    try:
        from IPython import display
    except ImportError:
        return page
    display.display(display.HTML(page))
    return profile
