"""Figures over all rows: joint ranks, power from histograms, hashed counts of values."""

import uuid
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import by_rows
from riskloom.functions import numeric
from riskloom.functions.expr import number
from riskloom.operators import clusters, columns, ranks, temporal
from riskloom.operators.columns import column_stats
from riskloom.operators.power import BINS, Classes, Numbers, bins_of, dealt, folded, histograms, power_frame


def jobs_of(spark, what) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        what()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    n = 3000
    wide = pd.DataFrame({"few": rng.integers(0, 6, n) * 1.0, "many": rng.normal(size=n).round(3), "tied": rng.choice([0.0, 0.0, 0.0, 1.5, 9.0], n)})
    wide.loc[rng.random(n) < 0.2, "many"] = np.nan
    wide["t"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 900, n), "h")
    wide["y"] = (wide.few + rng.normal(size=n) > 3).astype(int)
    wide["gain"] = (wide.few * 2 + rng.integers(0, 3, n)) * 1.0
    wide["kind"] = np.where(wide.y == 1, rng.choice(["a", "b"], n), rng.choice(["b", "c"], n))
    wide["label"] = np.where(wide.y == 1, "yes", "no")
    return wide, spark.createDataFrame(wide).repartition(5)


def test_joint_ranks_are_those_of_each_column(made):
    wide, df = made
    names = ["few", "many", "tied"]
    rows = df.where("y is not null")
    numbered = ranks.sided(rows, [number(n) for n in names], F.col("y") == 1)
    ks = {r.c: r for r in ranks.ks_of(numbered).collect()}
    area = {r.c: r for r in ranks.auc_of(numbered).collect()}
    rho = {r.c: r for r in ranks.rank_correlations(rows, [number(n) for n in names], number("gain")).collect()}
    for i, n in enumerate(names):
        own = wide[[n, "y", "gain"]].dropna()
        x, y = own[n].to_numpy(), own.y.to_numpy()
        assert ks[i].ks == pytest.approx(by_rows.ks_distance(x[y == 0], x[y == 1])) and (ks[i].n_a, ks[i].n_b) == ((y == 0).sum(), (y == 1).sum())
        assert area[i].auc == pytest.approx(numeric.auc(x, y == 1))
        assert rho[i].rho == pytest.approx(by_rows.spearman(x, own.gain.to_numpy())) and rho[i].n == len(own)
    assert ranks.ks_of(ranks.sided(df.limit(0), [number("few")], F.col("y") == 1)).count() == 0
    assert ranks.rank_correlations(df.withColumn("one", F.lit(1.0)), [number("one")], number("gain")).first().rho is None


def test_jobs_do_not_follow_the_number_of_features(made, spark):
    _, df = made
    wide = df.select("t", *[(F.col("few") + F.rand(i)).alias(f"f{i}") for i in range(40)])
    stats = column_stats(wide, parts=frozenset({"values"}))
    cut = temporal.late_cut(wide, "t")
    few, many = (jobs_of(spark, lambda n=n: temporal.drift_frame(wide, stats, [f"f{i}" for i in range(n)], "t", cut).collect()) for n in (3, 40))
    assert few == many


def test_drift_frame_against_pandas(made):
    wide, df = made
    cut = temporal.late_cut(df, "t")
    got = {r.feature: r for r in temporal.drift_frame(df, column_stats(df), ["many", "kind"], "t", cut).collect()}
    us = wide.t.astype("datetime64[us]").astype("int64").to_numpy()
    late = us >= cut
    assert cut == np.sort(us)[int(0.7 * len(us))] or (np.sort(us)[: int(0.7 * len(us))] < cut).all()
    x = wide.many.to_numpy()
    seen = ~np.isnan(x)
    assert got["many"].drift == pytest.approx(by_rows.ks_distance(x[seen & ~late], x[seen & late]))
    assert got["many"].monotonicity == pytest.approx(abs(by_rows.spearman(x[seen], us[seen].astype(float))))
    share = pd.crosstab(wide.kind, late, normalize="columns")
    assert got["kind"].drift == pytest.approx((share[False] - share[True]).abs().sum() / 2) and got["kind"].monotonicity is None


def test_histograms_count_every_row(made):
    wide, df = made
    stats = column_stats(df)
    bins = bins_of(df, stats, ["few", "many", "kind"])
    goal = bins_of(df, stats, ["gain"])["gain"]
    cells = histograms(df, stats, bins, "gain", goal, False).toPandas()
    for c, n in enumerate(bins):
        own = cells[cells.c == c]
        assert own.n.sum() == wide[n].notna().sum() and own.s.sum() == pytest.approx(wide.gain[wide[n].notna()].sum())
    assert len(bins["many"].values) <= BINS and bins["few"].values == sorted(wide.few.unique()) and bins["kind"].values == ["a", "b", "c"]
    table = cells[cells.c == 2].groupby(["bin", "y"]).n.sum()
    assert table.to_dict() == {(["a", "b", "c"].index(k), goal.values.index(g)): v for (k, g), v in wide.groupby(["kind", "gain"]).size().to_dict().items()}


def test_power_against_trees_on_the_rows(made):
    """Few values: the histogram holds all there is, so a split judged on its counts is the split judged on its rows."""
    wide, df = made
    stats = column_stats(df)
    late = F.col("t") >= F.lit("2024-01-25").cast("timestamp")
    test = (wide.t >= pd.Timestamp("2024-01-25")).to_numpy()
    got = {r.feature: r for r in power_frame(df, stats, ["few", "kind"], "label", True, ["no", "yes"], late).collect()}
    for n in ("few", "kind"):
        x = wide[n].to_numpy() if n == "few" else wide[n].map({"a": 0, "b": 1, "c": 2}).to_numpy(float)
        assert got[n].pps_time == pytest.approx(by_rows.predictive_power(x, wide.y.to_numpy(), 2, test), abs=1e-9)
        assert got[n].pps == pytest.approx(by_rows.predictive_power(x, wide.y.to_numpy(), 2), abs=0.05)
        assert got[n].n == 3000 and got[n].positive_count == min((wide.y == 1).sum(), (wide.y == 0).sum())
    got = power_frame(df, stats, ["few"], "gain", False, [], late).first()
    assert got.pps_time == pytest.approx(by_rows.predictive_power(wide.few.to_numpy(), wide.gain.to_numpy(), 0, test), abs=1e-9)
    assert got.pps == pytest.approx(by_rows.predictive_power(wide.few.to_numpy(), wide.gain.to_numpy(), 0), abs=0.02)
    # The same however rows are partitioned.
    again = power_frame(df.repartition(9), stats, ["few"], "gain", False, [], late).first()
    assert again == got


def test_power_of_a_rare_class_and_of_nothing(spark):
    df = spark.range(4000).selectExpr("cast(id % 7 as double) as x", "concat('c', cast(least(id, 3000) as string)) as y", "cast(id as string) as z")
    stats = column_stats(df)
    # 3,001 classes: all but the most frequent count as missed, and nothing fails.
    r = power_frame(df, stats, ["x"], "y", True, ["c3000"]).first()
    assert r.n == 4000 and r.pps == 0.0
    assert power_frame(df.limit(0), stats, ["x"], "y", True, ["c3000"]).count() == 0
    assert power_frame(df, stats, [], "y", True, ["c3000"]).count() == 0


def test_bootstraps_agree_with_numpy(made):
    wide, df = made
    r = power_frame(df, column_stats(df), ["few"], "label", True, ["no", "yes"], seeds=5, replicates=200).first()
    rng = np.random.default_rng(0)
    x, y = wide.few.to_numpy(), wide.y.to_numpy()
    areas = [numeric.auc(x[at], y[at] == 1) for at in (rng.integers(0, len(x), len(x)) for _ in range(200))]
    low, high = np.percentile(areas, [2.5, 97.5])
    assert r.auc_low == pytest.approx(low, abs=0.004) and r.auc_high == pytest.approx(high, abs=0.004)
    assert abs(r.pps_mean - r.pps) < 0.05 and r.pps_cov < 0.2


def test_deals_keep_every_row():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (9, 3))
    parts = folded(counts, 4, rng)
    assert (sum(parts) == counts).all() and max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 1
    assert dealt(counts, 10, rng).sum() == 10 and (dealt(counts, 10**6, rng) == counts).all()
    big = np.array([3_000_000_000, 1_000_000_000])
    assert abs(dealt(big, 1_000_000_000, rng).sum() / 1e9 - 1) < 1e-3
    assert Classes.area(np.array([[2, 1, 0], [1, 3, 0]])) == pytest.approx(numeric.auc(np.array([0, 0, 0, 1, 1, 1, 1]), np.array([0, 0, 1, 0, 1, 1, 1]) == 1))
    assert Numbers(np.array([0.0]), np.array([[1.0, 5.0, 9.0]])).median(np.array([[2, 1, 1]])) == 3.0


def test_rank_matrix_against_pandas(made):
    wide, df = made
    names = ["few", "many", "tied", "gain"]
    got = clusters.rank_correlations(df, column_stats(df), names)
    filled = wide[names].fillna(wide[names].median())
    want = filled.corr("spearman").abs().to_numpy()
    for i, j in combinations(range(4), 2):
        assert got[i, j] == pytest.approx(want[i, j], abs=1e-4)


def test_top_values_of_long_texts(spark):
    lead = "x" * columns.SHOWN
    rows = [lead + s for s in ("b", "a", "c", "c", "")] + ["z"] * 2 + [None, ""]
    s = column_stats(spark.createDataFrame([(r, r) for r in rows], "a string, b string"))
    want = [(lead + "c", 2), ("z", 2), ("", 1), (lead, 1), (lead + "a", 1), (lead + "b", 1)]
    assert s["a"].top_values == want and s["b"].top_values == want and s["a"].n_unique == 6
    # More texts of one frequency and one beginning than are looked up together.
    many = spark.range(columns.EDGE + 500).selectExpr(f"concat('{lead}', lpad(cast(id as string), 6, '0')) as a").union(spark.createDataFrame([("k",), ("k",)], "a string"))
    s = column_stats(many)["a"]
    assert s.top_values == [("k", 2)] + [(f"{lead}{i:06d}", 1) for i in range(9)] and s.n_unique == columns.EDGE + 501


def test_parts_leave_the_rest_alone(made):
    _, df = made
    whole, few = column_stats(df), column_stats(df, parts=frozenset({"bins"}))
    assert few["few"].histogram == whole["few"].histogram and few["few"].p50 is None and few["kind"].top_values == []
    near = column_stats(df, exact_quantiles=False)["many"]
    assert near.p50 == pytest.approx(whole["many"].p50, abs=0.01)


def test_forest_arrays_say_what_the_model_says(spark):
    from pyspark.ml.feature import VectorAssembler

    from riskloom.operators import forest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0) + (x[:, 1] > 1).astype(int)
    for label, classification in ((y.astype(float), True), (x[:, 0] * 2 + x[:, 1], False)):
        made = forest.fitted(spark, x, label, classification, trees=7, depth=4)
        said = made.says(x)
        assert said.shape == (400, 3 if classification else 1) and len(made.roots) == 7
        assert (said.argmax(1) == label).mean() > 0.85 if classification else np.corrcoef(said[:, 0], label)[0, 1] > 0.9
        if not classification:
            from pyspark.ml.regression import RandomForestRegressor

            rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=label)))
            want = RandomForestRegressor(numTrees=7, maxDepth=4, seed=42).fit(rows).transform(rows).select("a", "prediction").toPandas()
            assert np.allclose(said[:, 0], want.prediction)
    got = forest.permutation_importance(spark, pd.DataFrame(x, columns=list("abc")).assign(y=y.astype(float)), "y", True, trees=10)
    assert max(got, key=got.get) == "a" and got["a"] == 1.0 and got["c"] < got["b"]
    assert forest.permutation_importance(spark, pd.DataFrame({"a": x[:, 0], "y": y * 1.0}), "y", True) == {}
