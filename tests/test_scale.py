"""What one task reads: of large tables not more than its share."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom import queries, scratch
from riskloom.functions.expr import number
from riskloom.llm.collocations import collocations
from riskloom.operators import columns, ranks, target, temporal
from riskloom.queries import QUERIES
from riskloom.sources import sampling


def reads(spark, action) -> list[int]:
    """Rows that each task of the action's jobs read from a shuffle, most first."""
    sc = spark.sparkContext._jsc.sc()
    group = f"reads-{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        action()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sc.listenerBus().waitUntilEmpty()
    store, tracker = sc.statusStore(), spark.sparkContext.statusTracker()
    out = []
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                tasks = store.taskList(stage, 0, 10_000)
            except Exception:  # a stage that was skipped
                continue
            for i in range(tasks.size()):
                m = tasks.apply(i).taskMetrics()
                if m.isDefined():
                    out.append(m.get().shuffleReadMetrics().recordsRead())
    return sorted(out, reverse=True)


def test_a_class_of_the_sample_does_not_meet_in_one_task(spark):
    df = spark.range(80_000).select("id", F.when(F.col("id") % 8 == 0, "a").otherwise("b").alias("y"))
    found = []
    most = reads(spark, lambda: found.extend(sampling.stratified_sample(df, "y", 4000, 2).collect()))
    assert pd.Series([r.y for r in found]).value_counts().to_dict() == {"a": 2000, "b": 2000} and len({r.id for r in found}) == 4000
    # Four tasks hand on 2,000 of a class each; the exchange of all groups has a quarter of the rows a task.
    assert most[0] < 30_000


def test_a_sample_is_what_one_sort_of_all_rows_gives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.integers(0, 900, 20_000), "y": rng.choice([0.0, 1.0, np.nan], 20_000)}))
    monkeypatch.setattr(sampling, "HELD", 50)
    got = sorted(map(str, sampling.stratified_sample(df, "y", 900, 3).collect()))
    monkeypatch.setattr(sampling, "least_of_tasks", lambda groups, each: groups)
    assert got == sorted(map(str, sampling.stratified_sample(df, "y", 900, 3).collect())) and len(got) >= 600


def test_a_sample_out_of_many_tasks_does_not_meet_in_one(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    draws = (lambda: sampling.stratified_sample(df, "y", 2000, 2), lambda: sampling.exact_sample(df, 2000))
    few = [sorted(draw().collect()) for draw in draws]
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for draw, same in zip(draws, few):
            found = []
            most = reads(spark, lambda draw=draw, found=found: found.extend(draw().collect()))
            assert sorted(found) == same and len(same) == 2000
            # 64 tasks hand on 2,000 rows each to nine, which hand on as many.
            assert most[0] < 25_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_alike_in_their_beginning_do_not_meet_in_one_task(spark):
    df = spark.range(60_000).selectExpr("concat('a beginning that is the same in all of the texts, ', id) as note", "if(id < 3, concat('another beginning of more than forty letters ', id % 2), 'x') as few")
    found = {}
    most = reads(spark, lambda: found.update(columns.column_stats(df, parts=frozenset({"values"}))))
    assert found["note"].top_values == [(f"a beginning that is the same in all of the texts, {i}", 1) for i in sorted(map(str, range(60_000)))[:10]]
    assert found["few"].top_values == [("x", 59_997), ("another beginning of more than forty letters 0", 2), ("another beginning of more than forty letters 1", 1)]
    assert most[0] < 40_000


def test_levels_are_counted_without_sorting_rows(spark, sf0):
    df = spark.read.parquet(f"{sf0}/orders.parquet")
    counts = columns.level_counts(df, ["o_orderstatus", "o_orderpriority", "o_orderdate"])
    assert "HashAggregate" in plan(counts) and "SortAggregate" not in plan(counts)


def test_suffixes_of_phrases_are_not_sent_through_the_driver(spark):
    docs = spark.createDataFrame([("en", "one two three four five one two three") for _ in range(40)], "lang string, text string")
    shown = plan(collocations(docs, least=30))
    assert any("SortMergeJoin" in x and "suffix" in x for x in shown.splitlines()) and any("SortMergeJoin" in x and "phrase" in x for x in shown.splitlines())


def test_drift_and_ranks_share_one_sort_of_the_values(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 300, 4000) * 1.0
    wide = pd.DataFrame({"t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 500, 4000), "h"), "x": np.where(rng.random(4000) < 0.1, np.nan, x), "z": x + 1, "y": np.where(rng.random(4000) < 0.2, None, np.where(x > 200, "yes", "no"))})
    df = spark.createDataFrame(wide).repartition(5)
    stats = columns.column_stats(df, parts=frozenset({"values"}))
    values, us = [number(n) for n in ("x", "z")], F.unix_micros("t")
    alone = {r.c: (r.n, r.rho) for r in ranks.rank_correlations(df, values, us).collect()}
    target_alone = {r.c: r.rho for r in ranks.rank_correlations(df, values, F.when(F.col("y").isNotNull(), (F.col("y") == "yes").cast("double"))).collect()}
    cut = temporal.late_cut(df, "t")
    sorts, real = [], ranks.kept
    monkeypatch.setattr(ranks, "kept", lambda df, label: sorts.append(df.columns) or real(df, label))
    got = {r.feature: r for r in temporal.drift_frame(df, stats, ["x", "z"], "t", cut).collect()}
    # The values once, and the sums of their ranks at each time.
    assert len(sorts) == 2
    for c, n in enumerate(("x", "z")):
        assert got[n].n_a + got[n].n_b == alone[c][0] and got[n].monotonicity == pytest.approx(abs(alone[c][1]))
    sorts.clear()
    order = {r.feature: r.spearman for r in target.order_frame(df, stats, ["x", "z"], "y", ["no", "yes"]).collect()}
    assert len(sorts) == 2 and [order["x"], order["z"]] == pytest.approx([target_alone[0], target_alone[1]])


@pytest.mark.parametrize("table", ["orders", "events"])
def test_drift_alone_counts_no_distinct_values(spark, sf0, monkeypatch, table):
    asked, real = [], columns.column_stats
    monkeypatch.setattr(columns, "column_stats", lambda df, **k: asked.append(k["parts"]) or real(df, **k))
    assert queries.QUERIES[f"temporal_drift_{table}"](spark, sf0).count() >= 4
    assert asked == [frozenset()]


def test_times_are_sorted_once_for_buckets_cut_and_drift(spark, monkeypatch):
    rng = np.random.default_rng(12)
    hours = rng.integers(0, 700, 5000)
    wide = pd.DataFrame({"t": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"), "x": rng.integers(0, 9, 5000) + hours // 400 * 5.0, "y": np.where(rng.random(5000) < 0.2, None, np.where(rng.random(5000) < hours / 700, "a", "b")), "z": np.where(rng.random(5000) < 0.1, np.nan, hours * 3.0 + rng.integers(0, 5, 5000))})
    df = spark.createDataFrame(wide).repartition(5)
    stats = columns.column_stats(df)
    sorts, real = [], temporal.with_before
    monkeypatch.setattr(temporal, "with_before", lambda counts, *a: sorts.append(a[0]) or real(counts, *a))
    for y, classification in (("y", True), ("z", False)):
        sorts.clear()
        report = temporal.temporal_report(df, stats, "t", y)
        assert sorts.count("us") == 1
        assert (report.drift_kind, report.drift_score) == temporal.target_drift(df, "t", y, classification)
        target_of = temporal.followed(df, stats, y)
        shown = [(r.n_rows, r.n_target, r.value) for r in temporal.bucket_frame(df, "t", target_of).orderBy("bucket").collect()]
        assert [(b.n_rows, b.n_target) for b in report.buckets] == [r[:2] for r in shown] and [b.value for b in report.buckets] == pytest.approx([r[2] for r in shown])
        figures = {r.feature: r.drift for r in temporal.temporal_figures(df, stats, "t", y).collect()}
        assert {s.feature: s.drift for s in report.signals} == pytest.approx(figures)


def test_threads_release_only_their_own_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    since = scratch.mark()
    mine = scratch.kept(spark.range(5), "mine")

    def other():
        at = scratch.mark()
        seen = scratch.kept(spark.range(7), "other").count()
        scratch.release(at)
        scratch.release()
        return at, seen

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(other).result() == (0, 7)
    assert mine.count() == 5 and scratch.mark() == since + 1
    scratch.release(since)


def test_power_of_lineitem_reads_a_share_of_its_rows_a_task(spark, sf0, tmp_path):
    keys = [(F.col(k) + F.col("copy") * 1_000_000).alias(k) for k in ("l_orderkey", "l_partkey", "l_suppkey")]
    df = spark.read.parquet(f"{sf0}/lineitem.parquet").crossJoin(spark.range(80).withColumnRenamed("id", "copy"))
    df.select(*keys, *[c for c in df.columns if c not in ("copy", "l_orderkey", "l_partkey", "l_suppkey")]).write.parquet(f"{tmp_path}/lineitem.parquet")
    n, least = df.count(), df.groupBy("l_returnflag").count().agg(F.min("count")).first()[0]
    found = []
    most = reads(spark, lambda: found.extend(QUERIES["predictive_power_lineitem"](spark, str(tmp_path)).collect()))
    assert len(found) == 9 and all(r.n == n for r in found)
    # A quarter of the rows' hashes a task, and of a class 10,000 from each of four tasks.
    assert most[0] < 0.28 * n < least
