"""From findings to a preparation plan: what to drop, review, transform, encode, impute; how to split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from ..functions.kinds import BOOL, NUMERIC, TEXT
from ..operators.columns import ColumnStats
from ..operators.rules import RANK, Finding

BUCKETS = ("drop", "review", "transform", "encode", "impute")
DROPPED = frozenset({"all_null", "constant", "near_constant", "identifier_shape"})
REVIEWED = frozenset({"leakage", "temporal", "target"})


@dataclass
class ActionItem:
    column: str
    action: str
    reason: str
    severity: str
    evidence: list[str] = field(default_factory=list)


@dataclass
class Split:
    kind: str
    detail: str
    time_column: str | None = None
    cutoff: str | None = None
    val_cutoff: str | None = None
    stratify_on: str | None = None


@dataclass
class CrossValidation:
    kind: str
    detail: str
    n_splits: int = 5


@dataclass
class ClassStrategy:
    kind: str
    detail: str
    positive_rate: float | None = None


@dataclass
class ActionPlan:
    drop: list[ActionItem] = field(default_factory=list)
    review: list[ActionItem] = field(default_factory=list)
    transform: list[ActionItem] = field(default_factory=list)
    encode: list[ActionItem] = field(default_factory=list)
    impute: list[ActionItem] = field(default_factory=list)
    split: Split | None = None
    cv: CrossValidation | None = None
    class_strategy: ClassStrategy | None = None

    def records(self) -> list[dict[str, Any]]:
        return [{"bucket": b, **asdict(i)} for b in BUCKETS for i in getattr(self, b)]


def transform_for(s: ColumnStats | None) -> str:
    """A power where a number is skewed, of the logarithm's kind if it is never negative; otherwise scaling."""
    skewed = s is not None and s.kind == NUMERIC and abs(s.skew or 0.0) > 3
    return ("yeo_johnson", "log1p")[s.min is not None and s.min >= 0] if skewed else "robust_scaler"


@dataclass(frozen=True)
class Answer:
    """What a finding that fits asks for."""

    bucket: str
    fits: Callable[[Finding], bool]
    action: Callable[[ColumnStats | None], str]


def always(action: str) -> Callable[[ColumnStats | None], str]:
    return lambda _: action


#: In this order; the first that fits a finding answers it.
ANSWERS = (
    Answer("drop", lambda f: f.kind in DROPPED or (f.category, f.severity) == ("quality", "critical"), always("drop")),
    Answer("review", lambda f: f.category in REVIEWED and f.severity != "info", always("review")),
    Answer("transform", lambda f: f.category == "distribution", transform_for),
    Answer("review", lambda f: f.kind == "encoded_nulls", always("replace_sentinel_with_null")),
)


def impute_for(s: ColumnStats) -> str | None:
    if not 0 < s.null_rate < 1:
        return None
    if s.kind == NUMERIC:
        return "mode" if s.n_unique <= 2 else "median"
    return "mode" if s.kind in (TEXT, BOOL) else "impute_manually"


def encode_for(s: ColumnStats) -> str | None:
    if s.kind != TEXT or s.n_unique < 1:
        return None
    if s.n_unique <= 2:
        return "ordinal"
    if s.n_unique <= 20:
        return "onehot"
    return None if s.unique_rate > 0.5 else "target_oof"


def _put(items: list[ActionItem], new: ActionItem) -> None:
    """One item a column: the first action stays, the strongest severity keeps its reason, evidence adds up."""
    old = next((i for i in items if i.column == new.column), None)
    if old is None:
        items.append(new)
        return
    if RANK[new.severity] < RANK[old.severity]:
        old.severity, old.reason = new.severity, new.reason
    old.evidence += [e for e in new.evidence if e not in old.evidence]


def build_action_plan(profile: Any) -> ActionPlan:
    """The one plan that every surface shows."""
    plan = ActionPlan()
    for f in profile.findings:
        # The target itself is only ever reviewed for leaks.
        if not f.columns or (f.columns[0] == profile.target and f.category != "leakage"):
            continue
        if answer := next((a for a in ANSWERS if a.fits(f)), None):
            action = answer.action(profile.columns.get(f.columns[0]))
            _put(getattr(plan, answer.bucket), ActionItem(f.columns[0], action, f.title, f.severity, [f.title]))
    gone = {i.column for i in plan.drop}
    for s in profile.columns.values():
        if s.name == profile.target or s.name in gone:
            continue
        if how := impute_for(s):
            item = ActionItem(s.name, how, f"{s.null_rate:.1%} missing", "warning" if s.null_rate > 0.1 else "info", [f"{s.n_null} missing values"])
            _put(plan.review if how == "impute_manually" else plan.impute, item)
        if how := encode_for(s):
            _put(plan.encode, ActionItem(s.name, how, f"{s.n_unique} levels", "info", [f"{s.n_unique} levels"]))
    plan.split, plan.cv = split_for(profile)
    plan.class_strategy = class_strategy_for(profile)
    return plan


#: Kind of split: its folds, and what both say ({on}: column; {train}, {val}: where training and validation end).
SPLITS = {
    "temporal": ("time_series", "train up to {train}, validate up to {val}, test after", "folds in the order of {on}"),
    "stratified": ("stratified_kfold", "80/20, equal shares of {on}", "shuffled folds with equal shares of {on}"),
    "random": ("kfold", "80/20", "shuffled folds"),
}


def ends(labels: list[str]) -> tuple[str, str]:
    """Labels of the buckets with which training (70 %) and validation (85 %) end; each part keeps a bucket."""
    last = len(labels) - 1
    train = max(0, int(0.70 * len(labels)) - 1)
    return labels[train], labels[min(last - 1, max(train + 1, int(0.85 * len(labels)) - 1))]


def split_for(profile: Any) -> tuple[Split, CrossValidation]:
    labels = [b.label for b in profile.temporal.buckets] if profile.temporal and profile.time_column else []
    classes = getattr(profile.target_summary, "task", None) == "classification"
    kind = "temporal" if len(labels) >= 3 else "stratified" if classes else "random"
    train, val = ends(labels) if kind == "temporal" else (None, None)
    on = {"temporal": profile.time_column, "stratified": profile.target}.get(kind)
    folds, said, said_of_folds = SPLITS[kind]
    split = Split(kind, said.format(on=on, train=train, val=val), cutoff=train, val_cutoff=val)
    setattr(split, "time_column" if kind == "temporal" else "stratify_on", on)
    return split, CrossValidation(folds, said_of_folds.format(on=on))


def class_strategy_for(profile: Any) -> ClassStrategy | None:
    s = profile.target_summary
    if s is None or s.task != "classification" or not s.classes:
        return None
    if s.positive_rate is not None:
        if s.positive_rate >= 0.20:
            return None
        degree = "severe" if s.positive_rate < 0.05 else "moderate"
        return ClassStrategy("class_weight", f"{degree} imbalance ({s.positive_rate:.2%} positive): weight classes", s.positive_rate)
    least = min(n for _, n in s.classes)
    return ClassStrategy("class_weight", f"the smallest class has {least} rows: weight classes") if least < 50 else None


def categorize(profile: Any, plan: ActionPlan) -> dict[str, list[str]]:
    """Columns by how generated code treats them."""
    gone, how = {i.column for i in plan.drop}, {i.column: i.action for i in plan.encode}
    out: dict[str, list[str]] = {k: [] for k in ("numeric", "categorical_low", "categorical_high", "boolean", "drop", "passthrough")}
    out["drop"] = sorted(gone)
    for s in profile.columns.values():
        if s.name == profile.target or s.name in gone:
            continue
        if s.kind == BOOL or (s.kind == NUMERIC and s.n_unique <= 2):
            group = "boolean"
        elif s.kind == NUMERIC:
            group = "numeric"
        elif s.kind == TEXT and s.name in how:
            group = "categorical_high" if how[s.name] == "target_oof" else "categorical_low"
        else:
            group = "passthrough"
        out[group].append(s.name)
    return {k: sorted(v) for k, v in out.items()}
