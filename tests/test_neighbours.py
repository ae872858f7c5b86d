"""Mutual information over all rows: against the rows one by one, and without any sample."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import numeric
from riskloom.functions.expr import number
from riskloom.operators import columns, target
from riskloom.operators.neighbours import expected_digamma, level_information, number_information
from riskloom.queries import QUERIES

digamma = lambda x: float(numeric.digamma(np.array([x]))[0])


def mean_digamma(a: int, s: int, own: int, j: int) -> float:
    """Over all places r of the j-th of `own` among s: each order is as likely."""
    return sum(math.comb(r - 1, j - 1) * math.comb(s - r, own - j) / math.comb(s, own) * digamma(a + r) for r in range(j, s - own + j + 1))


def ross(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nats between a number and a class, row by row; the order of rows that are equally far is averaged over."""
    sizes = pd.Series(y).map(pd.Series(y).value_counts()).to_numpy()
    x, y = x[sizes > 1], y[sizes > 1]
    total, n = 0.0, len(x)
    for i in range(n):
        d, same, other = np.abs(x - x[i]), y == y[i], np.arange(n) != i
        near = min(k, same.sum() - 1)
        at = np.sort(d[same & other])[near - 1]
        nearer, as_far = (d < at * (1 - 1e-13)) & other, (np.abs(d - at) <= at * 1e-13) & other
        total += digamma(near) - digamma(same.sum()) - mean_digamma(nearer.sum(), as_far.sum(), (as_far & same).sum(), near - (nearer & same).sum())
    return max(0.0, digamma(n) + total / n)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    n = 400
    y = rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]).astype(object)
    y[:20], y[20], y[50:60] = [f"pair{i // 2}" for i in range(20)], "lone", None
    code = pd.factorize(y)[0]
    wide = pd.DataFrame({"real": rng.normal(size=n) + code % 3, "few": rng.integers(0, 5, n) + (code == 0) * 1.0, "whole": rng.integers(0, 150, n) * 1.0, "tenths": np.round(rng.integers(0, 90, n) * 0.1 + code % 2, 1), "heavy": np.where(rng.random(n) < 0.6, 0.0, rng.lognormal(0, 2, n)), "far": np.where(rng.random(n) < 0.04, 1e9, rng.integers(0, 40, n) * 1.0), "keys": np.arange(n) // 3 * 1.0})
    wide.loc[rng.random(n) < 0.1, "real"] = np.nan
    return wide, y


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_information_of_numbers_row_by_row(odd, spark, partitions):
    wide, y = odd
    df = spark.createDataFrame(wide.assign(y=y)).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {wide.columns[r.c]: r for r in number_information(df, [(number(n), F.col("y")) for n in wide]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for n in wide:
        ok = wide[n].notna().to_numpy() & pd.notna(y)
        assert got[n].n == ok.sum()
        assert got[n].mutual_info == pytest.approx(numeric.normalised(ross(wide[n].to_numpy()[ok], y[ok].astype(str))), abs=1e-9)


def test_mean_over_orders_of_rows_equally_far():
    rng = np.random.default_rng(1)
    asked = [(0, 9, 3, 2), (5, 7, 7, 3), (4, 700, 2, 1), (3, 900, 800, 3), (10, 600, 1, 1)]
    asked += [(int(a), s, own, int(rng.integers(1, min(3, own) + 1))) for a in rng.integers(0, 50, 40) for s in [int(rng.integers(1, 40))] for own in [int(rng.integers(1, s + 1))]]
    got = expected_digamma(*np.array(asked).T)
    assert got == pytest.approx([mean_digamma(*x) for x in asked], abs=1e-9)


def test_infinite_values_and_nothing(spark):
    df = spark.createDataFrame([(float(i % 5) if i % 4 else float("inf"), "ab"[i % 2]) for i in range(80)], "x double, y string")
    x, y = np.array([i % 5 if i % 4 else 8e307 for i in range(80)], float), np.array(["ab"[i % 2] for i in range(80)])
    assert number_information(df, [(number("x"), F.col("y"))]).first().mutual_info == pytest.approx(numeric.normalised(ross(x, y)), abs=1e-9)
    assert number_information(df.limit(0), [(number("x"), F.col("y"))]).count() == 0 and number_information(df, []).count() == level_information(df, []).count() == 0
    # Every row alone in its class.
    alone = number_information(spark.range(50), [(F.col("id") * 1.0, F.col("id"))]).first()
    assert (alone.n, alone.mutual_info) == (50, 0.0)


def test_levels_and_classes(odd, spark):
    wide, y = odd
    level = np.where(wide.few > 2, "high", "low")
    r = level_information(spark.createDataFrame(pd.DataFrame({"x": level, "y": y})), [(F.col("x"), F.col("y"))]).first()
    ok = pd.notna(y)
    assert r.n == ok.sum() and r.mutual_info == pytest.approx(numeric.normalised(numeric.mutual_information_classes(level[ok], y[ok].astype(str))))


def test_information_of_more_rows_than_a_sample_holds(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(target, "sample_frame", none)
    # One row in 1,000 has x = 9, which is always of class b.
    df = spark.range(90_000).selectExpr("case when id % 1000 = 0 then 9D else cast(id % 7 as double) end as x", "case when id % 1000 = 0 or id % 11 = 3 then 'b' when id % 2 = 0 then 'a' else 'c' end as y", "concat('k', id % 5) as z")
    got = {r.feature: r.mutual_info for r in target.signal_frame(df, columns.column_stats(df, parts=frozenset({"values"})), "y").collect()}
    rows = df.toPandas()
    cells, per_x, per_y = rows.groupby(["x", "y"]).size(), rows.groupby("x").size(), rows.groupby("y").size()
    nats = digamma(90_000) + sum(n * (digamma(n) - digamma(per_x[x]) - digamma(per_y[y])) for (x, y), n in cells.items()) / 90_000
    assert got["x"] == pytest.approx(numeric.normalised(nats), abs=1e-10) and got["x"] > 0.003
    assert got["z"] == pytest.approx(numeric.normalised(numeric.mutual_information_classes(rows.z, rows.y)), abs=1e-10)


def test_power_of_lineitem_draws_no_sample(spark, sf0, monkeypatch):
    monkeypatch.setattr(target, "sample_frame", lambda *_: pytest.fail("a sample was drawn"))
    found = QUERIES["predictive_power_lineitem"](spark, sf0).collect()
    assert len(found) == 9 and all(r.mutual_info is not None for r in found)


def test_a_numeric_target_against_levels_sees_all_rows(spark):
    df = spark.range(40_000).selectExpr("cast(id % 400 as double) / 3 as y", "concat('k', cast(id % 4 = 0 as int) + cast(id % 1000 = 7 as int)) as z", "cast((id * 7919) % 1000 as double) as x")
    stats = columns.column_stats(df, parts=frozenset({"values"}))
    got = {r.feature: r for r in target.signal_frame(df, stats, "y", bootstrap=3).collect()}
    want = number_information(df, [(number("y"), F.col("z"))]).first()
    assert want.n == 40_000 and got["z"].mutual_info == pytest.approx(want.mutual_info) and got["z"].mi_low is not None
    # Of two numbers it is taken from a sample.
    assert got["x"].mutual_info is not None and got["x"].mi_low <= got["x"].mi_high
