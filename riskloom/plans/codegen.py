"""Code and starter files made from a profile: Spark ML and scikit-learn pipelines, a notebook, a config."""

from __future__ import annotations

import json
from typing import Any

from .actions import ActionPlan, build_action_plan, categorize


def _names(columns: list[str]) -> str:
    return "[" + ", ".join(repr(c) for c in columns) + "]"


#: Fixed text of a generated Spark module, after its constants.
_SPARK = """

FOLDS, WEIGHT = 5, 20.0
LAMBDAS = [x / 4 for x in range(-8, 17)]


def quote(c):
    return "`" + c.replace("`", "``") + "`"


def number(c):
    return f"double({quote(c)})"


def yeo_johnson(c, power):
    x = number(c)
    up = f"log1p({x})" if power == 0 else f"(pow({x} + 1, {power}) - 1) / {power}"
    down = f"-log1p(-{x})" if power == 2 else f"-(pow(1 - {x}, {2 - power}) - 1) / {2 - power}"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def powers(train):
    \"\"\"The power of the greatest likelihood for each column of POWER, on a grid; one pass.\"\"\"
    if not POWER:
        return {}
    likely = [F.expr(f"-count({quote(c)}) / 2 * ln(var_pop({yeo_johnson(c, p)})) + ({p} - 1) * sum(sign({number(c)}) * log1p(abs({number(c)})))").alias(f"{i}_{j}") for i, c in enumerate(POWER) for j, p in enumerate(LAMBDAS)]
    found = train.agg(*likely).first()
    score = lambda i, j: found[f"{i}_{j}"] if found[f"{i}_{j}"] is not None and math.isfinite(found[f"{i}_{j}"]) else -math.inf
    return {c: LAMBDAS[max(range(len(LAMBDAS)), key=lambda j: (score(i, j), -abs(LAMBDAS[j] - 1)))] for i, c in enumerate(POWER)}


def target_number():
    return F.expr(number(TARGET)) if POSITIVE is None else F.when(F.col(quote(TARGET)).isNotNull(), (F.col(quote(TARGET)).cast("string") == POSITIVE).cast("double"))


def by_target(train, frame):
    \"\"\"frame with the level means of the target as _t0, _t1, ...: a row of train sees the other folds only, any other row all of train.\"\"\"
    if not (TARGET_ENCODED and TARGET):
        return frame
    fold = F.pmod(F.xxhash64(*[quote(c) for c in train.columns]), F.lit(FOLDS)).cast("int")
    base = train.select(*[F.col(quote(c)).cast("string").alias(f"_l{i}") for i, c in enumerate(TARGET_ENCODED)], target_number().alias("_y"), fold.alias("_fold")).where("_y is not null")
    sums = {r._fold: (r.s, r.n) for r in base.groupBy("_fold").agg(F.sum("_y").alias("s"), F.count("_y").alias("n")).collect()}
    s, n = (sum(v[k] for v in sums.values()) for k in (0, 1))
    # Fold -1 is left out of nothing.
    means = {k: (s - a) / max(1, n - b) for k, (a, b) in {-1: (0.0, 0), **dict.fromkeys(range(FOLDS), (0.0, 0)), **sums}.items()}
    mean = F.element_at(F.create_map(*[F.lit(x) for kv in means.items() for x in kv]), F.col("_fold"))
    out = frame.withColumn("_fold", fold if frame is train else F.lit(-1))
    for i, c in enumerate(TARGET_ENCODED):
        seen = base.groupBy(F.col(f"_l{i}").alias("_level"), "_fold").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
        whole = seen.groupBy("_level").agg(F.sum("_s").alias("_sums"), F.sum("_n").alias("_rows"))
        level = F.col(quote(c)).cast("string")
        out = out.join(whole, level.eqNullSafe(F.col("_level")), "left").drop("_level")
        own = seen.withColumnRenamed("_fold", "_of")
        out = out.join(own, level.eqNullSafe(F.col("_level")) & (F.col("_fold") == F.col("_of")), "left").drop("_level", "_of")
        rest = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
        out = out.withColumn(f"_t{i}", (rest("_sums", "_s") + WEIGHT * mean) / (rest("_rows", "_n") + WEIGHT)).drop("_s", "_n", "_sums", "_rows")
    return out.drop("_fold")


def build(train):
    \"\"\"The stages after by_target; fit them on what it returns.\"\"\"
    power = powers(train)
    column = {c: f"_n{i}" for i, c in enumerate(NUMERIC + FLAGS)}
    shape = lambda c: f"log1p({number(c)})" if c in LOG else yeo_johnson(c, power[c]) if c in POWER else number(c)
    stages, parts = [], []
    if column:
        stages.append(SQLTransformer(statement="select *, " + ", ".join(f"{shape(c)} as {n}" for c, n in column.items()) + " from __THIS__"))
    if NUMERIC:
        own = [column[c] for c in NUMERIC]
        stages.append(Imputer(strategy="median", inputCols=own, outputCols=[c + "_i" for c in own]))
        stages.append(VectorAssembler(inputCols=[c + "_i" for c in own], outputCol="_numeric"))
        stages.append(RobustScaler(inputCol="_numeric", outputCol="_scaled", withCentering=True))
        parts.append("_scaled")
    if FLAGS:
        own = [column[c] for c in FLAGS]
        stages.append(Imputer(strategy="mode", inputCols=own, outputCols=[c + "_i" for c in own]))
        parts += [c + "_i" for c in own]
    if ONE_HOT:
        own = [f"_c{i}" for i in range(len(ONE_HOT))]
        stages.append(StringIndexer(inputCols=ONE_HOT, outputCols=own, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=own, outputCols=[c + "_h" for c in own]))
        parts += [c + "_h" for c in own]
    if TARGET:
        parts += [f"_t{i}" for i in range(len(TARGET_ENCODED))]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def prepare(train, *others):
    \"\"\"train and the other frames with a `features` vector; everything is learnt from train.\"\"\"
    coded = [by_target(train, f) for f in (train, *others)]
    model = build(train).fit(coded[0])
    return [model.transform(f) for f in coded]
"""


def spark_pipeline(profile: Any, plan: ActionPlan | None = None) -> str:
    """A module whose prepare(train, *others) adds a `features` vector by pyspark.ml; levels are encoded by the target out of fold."""
    plan = plan or build_action_plan(profile)
    g, transforms = categorize(profile, plan), {i.column: i.action for i in plan.transform}
    shaped = lambda how: [c for c in g["numeric"] if transforms.get(c) == how]
    summary = profile.target_summary
    positive = None
    if summary is not None and summary.task == "classification":
        positive = summary.positive or (summary.classes[0][0] if summary.classes else None)
    constants = {
        "TARGET": profile.target,
        "POSITIVE": positive,
        "NUMERIC": g["numeric"],
        "LOG": shaped("log1p"),
        "POWER": shaped("yeo_johnson"),
        "FLAGS": g["boolean"],
        "ONE_HOT": g["categorical_low"],
        "TARGET_ENCODED": g["categorical_high"],
        "DROPPED": g["drop"],
        "PASSED": g["passthrough"],
    }
    head = f"Preparation of {profile.source_name}, written from its profile."
    imports = "import math\n\nfrom pyspark.ml import Pipeline\nfrom pyspark.ml.feature import Imputer, OneHotEncoder, RobustScaler, SQLTransformer, StringIndexer, VectorAssembler\nfrom pyspark.sql import functions as F\n"
    return f"{head!r}\n\n{imports}\n" + "\n".join(f"{k} = {v!r}" for k, v in constants.items()) + "\n" + _SPARK


def sklearn_pipeline(profile: Any, plan: ActionPlan | None = None) -> str:
    """The same plan as a scikit-learn module."""
    plan = plan or build_action_plan(profile)
    g, transforms = categorize(profile, plan), {i.column: i.action for i in plan.transform}
    by = lambda how: [c for c in g["numeric"] if transforms.get(c) == how]
    plain = [c for c in g["numeric"] if transforms.get(c) not in ("log1p", "yeo_johnson")]
    rows = [
        ("log", "Pipeline([('impute', SimpleImputer(strategy='median')), ('log', FunctionTransformer(np.log1p)), ('scale', StandardScaler())])", by("log1p")),
        ("power", "Pipeline([('impute', SimpleImputer(strategy='median')), ('power', PowerTransformer())])", by("yeo_johnson")),
        ("numeric", "Pipeline([('impute', SimpleImputer(strategy='median')), ('scale', RobustScaler())])", plain),
        ("flags", "SimpleImputer(strategy='most_frequent')", g["boolean"]),
        ("one_hot", "Pipeline([('impute', SimpleImputer(strategy='most_frequent')), ('encode', OneHotEncoder(handle_unknown='ignore'))])", g["categorical_low"]),
        ("by_target", "TargetEncoder()", g["categorical_high"]),
        ("passed", "'passthrough'", g["passthrough"]),
    ]
    steps = "\n".join(f"        ({name!r}, {code}, {_names(cols)})," for name, code, cols in rows if cols)
    return f'''"""Preparation of {profile.source_name}, written from its profile."""

import numpy as np
from sklearn.compose import ColumnTransformer
from sklearn.impute import SimpleImputer
from sklearn.pipeline import Pipeline
from sklearn.preprocessing import FunctionTransformer, OneHotEncoder, PowerTransformer, RobustScaler, StandardScaler, TargetEncoder

TARGET = {profile.target!r}
DROPPED = {_names(g["drop"])}


def build() -> ColumnTransformer:
    return ColumnTransformer([
{steps}
    ], remainder="drop")
'''


def notebook(path: str, target: str | None = None, time_col: str | None = None) -> str:
    """A starter notebook as JSON."""
    call = f"profile({path!r}, target={target!r}, time_col={time_col!r})"
    cells = [
        ("markdown", f"# Profile of {path}"),
        ("code", "from riskloom import profile\nfrom riskloom.session import session\n\nspark = session()"),
        ("code", f"p = {call}\np.show()"),
        ("markdown", "## Findings"),
        ("code", "p.findings_frame(spark).show(truncate=False)"),
        ("markdown", "## Features worth keeping"),
        ("code", "p.feature_shortlist(20)"),
        ("markdown", "## Plan"),
        ("code", "p.action_plan().records()"),
        ("code", "print(p.to_spark_pipeline_code())"),
    ]
    made = []
    for kind, source in cells:
        cell: dict[str, Any] = {"cell_type": kind, "metadata": {}, "source": source.splitlines(keepends=True)}
        made.append(cell | ({"execution_count": None, "outputs": []} if kind == "code" else {}))
    return json.dumps({"cells": made, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}, indent=1)


def starter_config(target: str | None, time_col: str | None, exclude: list[str]) -> str:
    """A TOML file for the command line."""
    lines = [f"target = {json.dumps(target)}" if target else '# target = "column"', f"time = {json.dumps(time_col)}" if time_col else '# time = "column"', f"exclude = {json.dumps(exclude)}", "fast = true", "", "[profiles.deep]", "deep = true", ""]
    return "\n".join(lines)
