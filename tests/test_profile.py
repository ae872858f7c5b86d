import importlib.util
import json
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import by_rows
from riskloom import cli
from riskloom.functions import numeric
from riskloom.operators import drift, ranks, rules, temporal
from riskloom.operators.columns import ColumnStats, column_stats, number_figures
from riskloom.operators.roles import hints, infer_excludes, infer_target, infer_time
from riskloom.operators.target import TargetSignal, ranked
from riskloom.plans.profile import Profile, load_profile, profile, profile_of_stats
from riskloom.render.html import profile_html
from riskloom.render.text import render_compare, render_diff, render_text
from riskloom.sources.demo import demo_frame


@pytest.fixture(scope="module")
def demo(spark):
    df = demo_frame(spark, 3000).toPandas()
    return profile(df, target="churned", time_col="signup_date", source_name="demo", target_permutation=False, bootstrap=5, pps_seeds=3, spark=spark)


def test_demo_findings(demo):
    kinds = {(f.kind, f.columns[0]) for f in demo.findings}
    assert {("constant", "status"), ("constant", "constant_col"), ("some_nulls", "income"), ("identifier_shape", "user_id"), ("target_pps_leak", "days_since_last_login"), ("temporal_leak", "cohort_engagement_v2"), ("heavy_skew", "revenue"), ("target_imbalance", "churned")} <= kinds
    assert ("identifier_shape", "referrer_id") not in kinds
    leak = next(s for s in demo.temporal.signals if s.feature == "cohort_engagement_v2")
    assert leak.pps_random > 0.3 and leak.pps_time < 0.05 and leak.drift > 0.3 and leak.leakage_kind in ("random_cv", "post_event"), leak
    assert demo.leakage_suspects()[0] == "days_since_last_login" and "constant_col" in demo.drop_candidates()
    assert [f.rank for f in demo.findings] == sorted(f.rank for f in demo.findings)
    top = demo.target_signals[0]
    assert top.pps > 0.95 and top.auc_ci[0] <= top.auc <= top.auc_ci[1] + 1e-9 and top.pps_cov < 0.1
    assert len(demo.temporal.buckets) == 10 and sum(b.n_rows for b in demo.temporal.buckets) == 3000


def test_plan_and_code(demo, spark, tmp_path):
    plan = demo.action_plan()
    by = {(r["bucket"], r["column"]): r["action"] for r in plan.records()}
    assert by["drop", "constant_col"] == "drop" and by["impute", "income"] == "median" and by["encode", "plan"] == "onehot" and by["transform", "revenue"] == "log1p"
    assert by["review", "cohort_engagement_v2"] == "review" and plan.split.kind == "temporal" and plan.cv.kind == "time_series"
    compile(demo.to_sklearn_pipeline_code(), "sk", "exec")
    path = tmp_path / "prep.py"
    path.write_text(demo.to_spark_pipeline_code())
    spec = importlib.util.spec_from_file_location("prep", path)
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    df = demo_frame(spark, 300)
    out = made.prepare(df)[0].select("features")
    assert out.count() == 300 and out.first().features.size >= 8


def test_generated_code_encodes_out_of_fold(spark):
    rng = np.random.default_rng(4)
    n = 2000
    rows = pd.DataFrame({"town": [f"t{i}" for i in rng.integers(0, 400, n)], "gain": -rng.lognormal(0, 1.5, n), "place": np.arange(n) * 1.0, "won": rng.choice(["no", "yes"], n)})
    rows.loc[:10, "town"] = None
    df = spark.createDataFrame(rows)
    p = profile(df, target="won", deep_correlations=False, target_permutation=False, spark=spark)
    made: dict = {}
    exec(p.to_spark_pipeline_code(), made)
    assert made["TARGET_ENCODED"] == ["town"] and made["POWER"] == ["gain"] and made["POSITIVE"] in ("no", "yes")
    train, same = (f.orderBy("place").toPandas() for f in made["prepare"](df, df.select("*")))
    assert len(train) == len(same) == n and train._t0.notna().all()
    y = (train.won == made["POSITIVE"]).astype(float)
    # The target is a coin: what rows see of their own outcome shows as correlation, which only the in-sample means have.
    assert abs(np.corrcoef(train._t0, y)[0, 1]) < 0.12 and np.corrcoef(same._t0, y)[0, 1] > 0.25
    power = made["powers"](df)["gain"]
    assert 1 < power <= 4 and abs(train._n0).max() < abs(rows.gain).max()


def test_diff_and_compare_rules(spark):
    column = lambda name, kind, **k: ColumnStats(name, kind, kind, 1000, 0, 2, **k)
    yes, flag = column("f", "text", top_values=[("true", 700), ("false", 300)]), column("f", "bool", top_values=[("true", 300), ("false", 700)])
    assert drift.feature_drift(yes, flag).js > 0.05 and drift.feature_drift(yes, column("f", "numeric")).kind == "other"
    a, b = profile_of_stats({"f": yes}, "f", "a"), profile_of_stats({"g": yes}, "g", "b")
    assert drift.target_delta(a, b) is None
    a.target_signals = [TargetSignal(f"s{i}", 1 - i / 40) for i in range(30)]
    b.target_signals = [TargetSignal("new", 1.0), *a.target_signals[:28]]
    d = a.diff(b)
    assert d.schema_added == ["g"] and d.schema_removed == ["f"] and (d.name_before, d.name_after) == ("a", "b")
    assert [(c.feature, c.before, c.after) for c in d.rank_changes] == [("s29", 30, None), ("s28", 29, None), ("new", None, 1)] and d.rank_changes[2].score_after == 1.0


def test_saving_and_rendering(demo, spark, tmp_path):
    again = load_profile(demo.save(tmp_path / "p.json"))
    assert again.to_json() == demo.to_json() and isinstance(again, Profile) and again.temporal.signals == demo.temporal.signals
    assert json.loads(demo.to_json())["schema_version"] == 1
    for v in (True, "1", 7):
        with pytest.raises(ValueError):
            Profile.from_dict(demo.to_dict() | {"schema_version": v})
    page = profile_html(again)
    assert "<svg" in page and "cohort_engagement_v2" in page and "http" not in page.replace("http-equiv", "")
    assert "days_since_last_login" in render_text(again, all_columns=True)
    assert demo.findings_frame(spark).count() == len(demo.findings) and demo.columns_frame(spark).count() == 15
    assert demo.target_signal_frame(spark).count() == len(demo.target_signals) and demo.shortlist_frame(spark).count() > 0
    d = demo.diff(again)
    assert not d.appeared and not d.resolved and render_diff(d) == "nothing changed\n"


def test_small_tables(spark):
    rng = np.random.default_rng(0)
    n = 1000
    df = (
        pd.DataFrame({
            "x": rng.normal(size=n), "near": [0] * (n - 5) + [1, 2, 3, 4, 5], "flag": rng.integers(0, 2, n), "day": [f"2024-01-{i % 28 + 1:02d} x" for i in range(n)],
            "review": [f"a long text number {i} with many words in it to read" for i in range(n)], "city": rng.choice(["NA", "b", "c"], n, p=[0.5, 0.3, 0.2]), "target": rng.choice(["a", "b", "c"], n),
        }).assign(empty=pd.Series([None] * n, dtype="float"), some=lambda d: d.x.where(rng.random(n) > 0.3), y2=lambda d: d.x**2)
    )
    p = profile(df, target="target", target_permutation=True, spark=spark)
    kinds = {(f.kind, f.columns[0]) for f in p.findings}
    assert {("all_null", "empty"), ("near_constant", "near"), ("bool_as_int", "flag"), ("date_as_string", "day"), ("free_text", "review"), ("high_cardinality_text", "review"), ("encoded_nulls", "city"), ("some_nulls", "some")} <= kinds
    assert any(f.kind == "nonlinear_association" and set(f.columns) >= {"x", "y2"} for f in p.findings)
    assert p.action_plan().split.kind == "stratified" and p.temporal is None
    assert any({"x", "some"} <= set(c.members) for c in p.clusters.clusters)
    for bad in ({"sample": 0}, {"hist_bins": 0}, {"cluster_cutoff": 2}, {"max_cols": 1}, {"bootstrap": -1}, {"target": "gone"}, {"time_col": "x"}):
        with pytest.raises(ValueError):
            profile(df, spark=spark, **bad)
    few = profile(df, max_cols=2, sample=200, deep_correlations=False, spark=spark)
    assert few.n_rows == 200 and len(few.correlations) <= 1


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "a int, b string, c timestamp")
    assert profile(none, spark=spark).n_rows == 0
    odd = spark.createDataFrame([(1, [1, 2], {"k": 1}, True, float("nan")), (2, None, None, None, 1.0), (2, [1, 2], {"k": 1}, False, None)], "`a.b` int, l array<int>, m map<string,int>, t boolean, d double")
    s = column_stats(odd)
    assert s["a.b"].n_unique == 2 and s["l"].top_values == [("[1,2]", 2)] and s["m"].n_null == 1 and s["t"].kind == "bool"
    assert s["d"].mean == 1.0 and s["d"].n_null == 1
    with pytest.raises(ValueError):
        profile(odd, target="l", spark=spark)


def test_compare(spark, tmp_path):
    rng = np.random.default_rng(1)
    make = lambda m, extra: spark.createDataFrame(pd.DataFrame({"age": rng.normal(m, 8, 2000), "income": rng.lognormal(10, 0.5, 2000), "segment": rng.choice(["a", "b"], 2000), "target": rng.integers(0, 2, 2000)} | extra))
    a = profile(make(35, {"old": 1.0}), target="target", deep_correlations=False, target_permutation=False, spark=spark)
    b = profile(make(55, {"new": "x"}), target="target", deep_correlations=False, target_permutation=False, spark=spark)
    r = drift.compare_profiles(a, b)
    assert r.features[0].name == "age" and r.features[0].ks > 0.5 and r.features[0].ks_p < 1e-6 and r.features[0].severity == "warning"
    assert r.schema.added == ["new"] and r.schema.removed == ["old"] and r.target.kind == "binary"
    assert json.loads(r.save(tmp_path / "c.json").read_text())["features"][0]["name"] == "age" and "age" in render_compare(r)
    many = ColumnStats("c", "string", "text", 1000, 0, 400, top_values=[("a", 100)])
    assert drift.feature_drift(many, many).js is None


def test_figures_against_known_values():
    assert abs(numeric.ks_p_value(0.274, 10) - 0.3715) < 1e-3 and abs(numeric.chi2_p_value(3.841, 1) - 0.05) < 1e-4
    assert drift.chi_square(np.array([10.0, 20.0]), np.array([20.0, 10.0]))[0] == pytest.approx(5.4)
    assert drift.rebin([(0, 10, 100)], np.array([0.0, 5, 10])).tolist() == [50, 50]
    assert numeric.average_ranks(np.array([3.0, 1, 3])).tolist() == [2.5, 1, 2.5]
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = 0.6 * x + 0.8 * rng.normal(size=2000)
    assert numeric.mutual_information_numbers(x, y) == pytest.approx(-0.5 * np.log(1 - 0.36), abs=0.05)
    assert numeric.mutual_information_mixed(x, x > 0) == pytest.approx(np.log(2), abs=0.02)
    brute = np.array([np.sort(np.maximum(abs(x[:300] - x[i]), abs(y[:300] - y[i])))[3] for i in range(300)])
    assert np.allclose(numeric._joint_radius(x[:300], y[:300], 3), brute)
    assert numeric.average_linkage(np.array([[0, 0.3, 0.9], [0.3, 0, 0.9], [0.9, 0.9, 0]]), 0.3) == [[0, 1], [2]]
    assert by_rows.predictive_power(x, (x > 0.3).astype(int), 2) > 0.99 and by_rows.predictive_power(x, rng.integers(0, 2, 2000), 2) < 0.2


def test_tree_against_brute_force():
    rng = np.random.default_rng(3)
    for classes in (0, 3):
        x = rng.integers(0, 12, 60).astype(float)
        y = rng.integers(0, classes, 60) if classes else rng.normal(size=60)

        def loss(v):
            return len(v) - (np.bincount(v, minlength=classes) ** 2).sum() / len(v) if classes else ((v - v.mean()) ** 2).sum()

        cuts = (np.unique(x)[1:] + np.unique(x)[:-1]) / 2
        best = min(loss(y[x <= c]) + loss(y[x > c]) for c in cuts)
        got = by_rows.tree_intervals(x, y, classes, 1)[0][0]
        assert loss(y[x <= got]) + loss(y[x > got]) == pytest.approx(best)


def test_ladder():
    assert temporal.classify(0.5, 0.1, 0.2, 0.1, 0) == ("critical", "random_cv")
    assert temporal.classify(None, None, 0.6, 1.0, 1) == ("info", "strong_drift")
    assert temporal.classify(None, None, 0.1, 0.96, 0.95) == ("warning", "monotonic")
    assert temporal.infer_kind("critical", "") == "random_cv" and temporal.infer_kind("info", "") == "strong_drift"


def test_views(demo):
    from types import SimpleNamespace as Made

    from riskloom.operators.association import Pair
    from riskloom.render import views
    from riskloom.render.html import profile_html

    assert views.sparkline([0, 1, 7], 3) == " ▂█" and views.sparkline([0, 0]) == "▁▁" and len(views.sparkline(list(range(24)))) == 16 and views.sparkline([1, 3, 0, 0], 2) == "█ "
    stats = {n: ColumnStats(n, "double", kind, 10, 0, 5, mean=1.0) for n, kind in (("z", "numeric"), ("a", "numeric"), ("t", "text"), ("b", "numeric"), ("c", "numeric"))}
    p = Made(columns=stats, correlations=[Pair("b", "c", -0.9, None), Pair("a", "t", None, 0.5), Pair("a", "b", None, 0.4)], findings=[Made(columns=["c"])], target="t", target_signals=[TargetSignal("b")], clusters=Made(shortlist=[Made(feature="a")]))
    assert views.shown_columns(p) == ["c", "t", "b", "a", "z"] and views.shown_columns(p, 2) == ["c", "t"]
    assert views.heat(p, "pearson", 3) == (["b", "c", "a"], {frozenset("bc"): -0.9}) and views.heat(p, "mutual_info")[0] == ["z", "a", "b", "c"]
    assert views.heat(Made(columns=stats, correlations=[Pair("a", "b", 0.5)]), "mutual_info") == ([], {})
    page = profile_html(demo)
    assert page.count("<h3>Correlation</h3>") == 1 and "<circle" in page and "skew +" in render_text(demo) and "Strongest pairs" in render_text(demo)


def test_flags_of_a_configuration(tmp_path, capsys):
    args = lambda *a: cli.parser().parse_args(["profile", "x.csv", "--config", str(tmp_path / "c.toml"), *a])
    for text, want in (("fast = true", False), ("fast = false", True), ("deep = true", True), ("deep = false", False), ("", False), ("fast = false\ndeep = true", True)):
        (tmp_path / "c.toml").write_text(text)
        assert cli.options(args())["deep_correlations"] is want, text
    assert cli.options(args("--fast"))["target_permutation"] is False and cli.options(args("--approximate-quartiles"))["exact_quantiles"] is False
    for bad in ('fast = "yes"', "deep = 1", "fast = true\ndeep = true", "fast = false\ndeep = false", "all_columns = 0\napproximate_quartiles = 3"):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(cli.UsageError):
            cli.options(args())


def test_roles_and_signals():
    s = lambda name, kind, unique, n=1000: ColumnStats(name, kind, kind, n, 0, unique)
    stats = {x.name: x for x in (s("user_id", "numeric", 1000), s("created_at", "temporal", 500), s("other_day", "temporal", 500), s("churned", "numeric", 2), s("note", "text", 900))}
    assert infer_target(stats) == "churned" and infer_time(stats) == "created_at" and infer_excludes(stats, "churned", "created_at") == ["user_id", "note"]
    assert hints(stats["churned"]) == ["boolean"] and hints(stats["user_id"]) == ["identifier"]
    got = ranked([TargetSignal("a", 0.3), TargetSignal("b", 0.7), TargetSignal("c", 0.1)])
    assert [x.feature for x in got] == ["b", "a", "c"] and [x.leak_suspect for x in got] == [True, False, False]
    assert TargetSignal("a", n=500).confidence == "medium" and TargetSignal("a", n=5000, positive_count=10).confidence == "low"
    assert rules.severity_counts([]) == {"critical": 0, "warning": 0, "info": 0}


def test_command_line(spark, tmp_path, capsys):
    df = demo_frame(spark, 1200).toPandas()
    data = tmp_path / "d.csv"
    df.to_csv(data, index=False)
    (tmp_path / "c.toml").write_text('target = "churned"\nexclude = ["user_id"]\n[profiles.deep]\ndeep = true\n')
    saved, page = tmp_path / "p.json", tmp_path / "p.html"
    assert cli.main(["profile", str(data), "--config", str(tmp_path / "c.toml"), "--time", "signup_date", "--save", str(saved), "--html", str(page), "--filter", "age > 20"]) == 0
    assert "days_since_last_login" in capsys.readouterr().out and page.exists()
    assert cli.main(["compare", str(saved), str(saved), "--save", str(tmp_path / "x.json")]) == 0
    assert cli.main(["diff", str(saved), str(saved)]) == 0 and cli.main(["render", str(saved), "--html", str(tmp_path / "r.html")]) == 0
    assert cli.main(["doctor", str(data)]) == 0 and "target: churned" in capsys.readouterr().out
    assert cli.main(["init", str(data), "--output", str(tmp_path / "o.toml")]) == 0 and 'target = "churned"' in (tmp_path / "o.toml").read_text()
    assert cli.main(["notebook", str(data), "--output", str(tmp_path / "n.ipynb")]) == 0 and json.loads((tmp_path / "n.ipynb").read_text())["nbformat"] == 4
    for bad in (["profile", "none.csv"], ["init", str(data), "--output", str(tmp_path / "o.toml")], ["profile", str(data), "--fast", "--deep"], ["profile", "ftp://x/y"]):
        assert cli.main(bad) == 2
    (tmp_path / "bad.toml").write_text("tarjet = 1")
    assert cli.main(["profile", str(data), "--config", str(tmp_path / "bad.toml")]) == 2 and "target" in capsys.readouterr().err
    assert "typer" not in sys.modules


def test_registered_queries_ask_for_the_operators_own_defaults(spark, tmp_path, monkeypatch):
    from riskloom import queries
    from riskloom.operators import target
    from riskloom.plans import profile as plans

    rng = np.random.default_rng(1)
    frame = pd.DataFrame({f"l_{c}": rng.normal(size=4000) for c in "abcdef"} | {"l_returnflag": rng.choice(["A", "N", "R"], 4000)})
    frame["l_linestatus"] = np.where(frame.l_f > 0, "O", "F")
    frame.to_parquet(tmp_path / "lineitem.parquet")
    seen = {}

    def fake(spark, sample, target, classification, **other):
        seen["rows"], seen["columns"], seen["other"] = len(sample), set(sample.columns), other
        return {"l_f": 1.0}

    monkeypatch.setattr(target, "permutation_importance", fake)
    queries.QUERIES["permutation_importance_lineitem"](spark, str(tmp_path))
    assert seen == {"rows": 4000, "columns": set(frame.columns), "other": {}}
    asked = []
    real = plans.profile
    monkeypatch.setattr(plans, "profile", lambda data, **k: asked.append(k) or real({"x": [1, 2]}, spark=spark))
    for name in ("profile_findings_labels", "profile_diff_events"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [set(k) for k in asked] == [{"target", "spark"}] * 3


def test_permutation_importance_finds_the_feature(spark):
    from riskloom.operators.target import permutation_importance

    rng = np.random.default_rng(2)
    sample = pd.DataFrame({"x": rng.normal(size=300), "noise": rng.normal(size=300)})
    got = permutation_importance(spark, sample.assign(y=(sample.x > 0).astype(float)), "y", True)
    assert got["x"] == 1.0 and got["noise"] < 0.3


def test_time_figures_come_from_all_rows(spark):
    df = spark.range(12_000).selectExpr("timestamp_seconds(id * 60) as t", "case when id % 20 = 0 then id % 7 + (id div 9000) * 10 end as sparse", "id % 5 as other", "cast(id >= 11000 as int) as y")
    report = temporal.temporal_report(df, column_stats(df), "t", "y")
    by = {s.feature: s for s in report.signals}
    assert by["sparse"].drift > 0.8 and by["other"].drift == pytest.approx(0, abs=1e-3)
    assert report.drift_kind == "binary" and report.drift_score == pytest.approx(1000 / 1200)


def test_ranges_agree_however_often_they_are_run(spark):
    rng = np.random.default_rng(8)
    wide = pd.DataFrame({"few": rng.integers(0, 5, 4000) * 1.0, "one": 7.0, "many": rng.normal(0, 1, 4000), "skewed": rng.lognormal(0, 2, 4000).round(1)})
    df = spark.createDataFrame(wide).repartition(7)
    for _ in range(3):
        got = {df.columns[r.c]: list(r.q) for r in number_figures(df, True).collect()}
        assert all(got[n] == pytest.approx(list(wide[n].quantile([0.25, 0.5, 0.75]))) for n in wide)
    per = df.groupBy(F.col("skewed").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    before = {r.v: r.before_n for r in ranks.with_before(per, "v", ["n"]).collect()}
    assert before == {v: int((wide.skewed < v).sum()) for v in wide.skewed.unique()}
    assert ranks.with_before(per.limit(0), "v", ["n"]).count() == 0
