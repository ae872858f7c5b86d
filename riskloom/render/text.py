"""Reports for a terminal."""

from __future__ import annotations

from typing import Any

from .views import figure, health, null_share, shape, shown_columns, shown_findings, summary

MARK = {"critical": "!!", "warning": " !", "info": "  "}


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    width = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    return [line(head), line(["-" * w for w in width]), *map(line, rows)]


def render_text(profile: Any, all_columns: bool = False) -> str:
    score, word = health(profile)
    out = [f"{profile.source_name}: {profile.n_rows:,} rows, {profile.n_cols} columns, {null_share(profile):.1%} missing, health {score} ({word})", ""]
    shown = shown_findings(profile.findings)
    out += [f"{MARK[f.severity]} [{f.category}] {f.title}" + (f" - {f.detail}" if f.detail else "") for f in shown]
    if len(shown) < len(profile.findings):
        out.append(f"   and {len(profile.findings) - len(shown)} more")
    names = list(profile.columns) if all_columns else shown_columns(profile)
    rows = [[s.name, s.dtype, f"{s.null_rate:.1%}" if s.n_null else "", figure(s.n_unique), shape(s), summary(s)] for s in (profile.columns[n] for n in names)]
    out += ["", *_table(["column", "type", "missing", "unique", "shape", "summary"], rows)]
    if len(names) < len(profile.columns):
        out.append(f"   and {len(profile.columns) - len(names)} more columns (--all-columns)")
    if pairs := [p for p in profile.correlations if p.score >= 0.3][:10]:
        rows = [[p.a, p.b, figure(p.pearson), figure(p.mutual_info), "not linear" if p.is_nonlinear else ""] for p in pairs]
        out += ["", "Strongest pairs", *_table(["a", "b", "correlation", "mi", ""], rows)]
    if profile.target_signals:
        rows = [[s.feature, figure(s.pps), figure(s.mutual_info), figure(s.auc), figure(s.spearman), s.confidence, "leak?" if s.leak_suspect else ""] for s in profile.target_signals[:15]]
        out += ["", f"What predicts {profile.target}", *_table(["feature", "pps", "mi", "auc", "rho", "confidence", ""], rows)]
    if profile.temporal:
        rows = [[s.feature, figure(s.pps_random), figure(s.pps_time), figure(s.drift), s.severity, s.leakage_kind] for s in profile.temporal.signals[:15]]
        out += ["", f"Over {profile.temporal.time_column}", *_table(["feature", "random", "by time", "drift", "severity", "kind"], rows)]
        out += [f"  {b.label}: {b.n_rows:,} rows" + (f", {b.value:.4g}" if b.value is not None else "") for b in profile.temporal.buckets]
        if profile.temporal.drift_kind:
            out.append(f"  target drift ({profile.temporal.drift_kind}): {figure(profile.temporal.drift_score)}")
    if profile.clusters and profile.clusters.shortlist:
        rows = [[e.feature, figure(e.score), e.method, ", ".join(e.redundant[:4]) + (", ..." if len(e.redundant) > 4 else ""), "weak" if e.weak else ""] for e in profile.clusters.shortlist[:20]]
        out += ["", "Shortlist", *_table(["feature", "score", "by", "stands for", ""], rows)]
    plan = profile.action_plan()
    rows = [[r["bucket"], r["column"], r["action"], r["reason"]] for r in plan.records()[:30]]
    if rows:
        out += ["", *_table(["plan", "column", "action", "because"], rows)]
    if plan.split:
        out += ["", f"Split: {plan.split.kind}, {plan.split.detail}. Validation: {plan.cv.kind}." + (f" {plan.class_strategy.detail}." if plan.class_strategy else "")]
    return "\n".join(out) + "\n"


def render_compare(report: Any) -> str:
    out = [f"{report.name_a} ({report.rows_a:,} rows) and {report.name_b} ({report.rows_b:,} rows)", ""]
    out += [f"{MARK[f.severity]} [{f.category}] {f.title}" + (f" - {f.detail}" if f.detail else "") for f in report.findings]
    rows = [[d.name, d.kind, figure(d.drift_score), figure(d.ks), figure(d.psi), figure(d.js), f"{d.null_delta:+.1%}", d.severity] for d in report.top(30)]
    return "\n".join([*out, "", *_table(["column", "kind", "drift", "KS", "PSI", "JS", "missing", "severity"], rows)]) + "\n"


def render_diff(diff: Any) -> str:
    out = [f"+ {f.severity}: {f.title}" for f in diff.appeared] + [f"- {f.severity}: {f.title}" for f in diff.resolved]
    out += [f"+ column {n}" for n in diff.schema_added] + [f"- column {n}" for n in diff.schema_removed]
    out += [f"~ {c.title}: {c.before} to {c.after}" for c in diff.severity_changes]
    out += [f"# {m.feature}: rank {m.before or '-'} to {m.after or '-'}" for m in diff.rank_changes]
    return "\n".join(out or ["nothing changed"]) + "\n"
