"""Dataset-risk profiling on Spark: which columns will hurt a model, and why."""

from __future__ import annotations

_PUBLIC = {
    "profile": "plans.profile",
    "Profile": "plans.profile",
    "load_profile": "plans.profile",
    "ProfileDiff": "plans.profile",
    "compare_profiles": "operators.drift",
    "CompareReport": "operators.drift",
    "ActionPlan": "plans.actions",
    "build_action_plan": "plans.actions",
    "ColumnStats": "operators.columns",
    "column_stats": "operators.columns",
    "Finding": "operators.rules",
    "Source": "sources.load",
    "load": "sources.load",
    "discover_schema": "sources.load",
    "parse_filter": "sources.filters",
    "demo_frame": "sources.demo",
    "write_html": "render.html",
    "write_compare_html": "render.html",
    "render_text": "render.text",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    """Public names load their module on first use, so that reading one part never needs the others."""
    if name in _PUBLIC:
        from importlib import import_module

        return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
    raise AttributeError(name)
