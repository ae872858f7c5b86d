"""op12 and op13 against brute force, with odd rows and hot groups."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from riskloom.llm import nearest as nn
from riskloom.llm import variants
from riskloom.llm.variants import variant_groups


def vocabulary(rows):
    n = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    v = vocabulary(rows)
    form, out = {}, {}
    for w, n in v.items():
        close = [x for x in v if near(w, x)]
        best = min(close, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * n else None
        out[w] = (n, len(close))
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, k, v.get(form[w])) for w, (n, k) in out.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bases = ["banana", "bananas", "ananas", "aaaaa", "aaaaaa", "étéétéé", "straße", "Überall", "×÷×÷×", "letter", "LETTER", "lettre", "abcdefghijklmnopqrst"]
    rows = []
    for i in range(400):
        words = rng.choices(bases, range(len(bases), 0, -1), k=rng.randrange(0, 30))
        for k in range(len(words)):
            if rng.random() < 0.3:
                w, at = words[k], rng.randrange(len(words[k]))
                words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return [*rows, (None, "banana banana"), (7, None), (8, ""), (9, "12 34"), (3, "banana"), (3, "banana"), (10, "x" * 6000 + " " + "y" + "x" * 5999), *[(11, "x" * 6000)] * 3, *[(12, "y" + "x" * 5999)] * 8, *[(13, "planter")] * 26, *[(14, "planters")] * 12, *[(15, "planterss")] * 5]


@pytest.mark.parametrize("most", [100_000, 3])
def test_groups_against_brute_force(spark, texts, monkeypatch, most):
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "AT_LEAST", 50)
    df = spark.createDataFrame([(k, t, "w", 1, "f") for k, t in texts], "doc_id long, text string, word string, n int, form string").repartition(3)
    got = [tuple(r) for r in variant_groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(texts)
    assert len(got) == len(want) and set(got) == want
    assert any(r[2] != r[1] and r[1] for r in got)  # a chain of forms


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variant_groups(none).count() == 0
    assert variant_groups(spark.createDataFrame([(1, None), (2, "one two 3")], none.schema)).count() == 0
    alone = variant_groups(spark.createDataFrame([(1, "lonely")] * 3, none.schema)).collect()
    assert [tuple(r) for r in alone] == [("lonely", None, "lonely", 3, 0, None)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    x[100:400] = x[100]  # copies: one class
    x[700:760] = x[700] + 0.05 * rng.normal(size=(60, 24))
    return x


def nearest_by_hand(ids, x, q):
    score = x @ x[q]
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(float(score[i]), 9), ids[i]))
    return [ids[i] for i in order[:20]]


def test_recall_and_scores(spark, vectors, monkeypatch):
    monkeypatch.setattr(nn, "SHARD", 200)
    monkeypatch.setattr(nn, "LEAF", 16)
    monkeypatch.setattr(nn, "SERVED", 30)
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": vectors.tolist(), "query_id": 1, "rank": 2, "shard": "s"})).repartition(4)
    got = nn.nearest(df).toPandas()
    assert sorted(got.query_id.unique()) == ids[::20] and (got.groupby("query_id").size() == 20).all()
    assert np.allclose(got.score, (vectors[got.query_id] * vectors[got.vec_id]).sum(1), rtol=1e-12)
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and q not in rows.vec_id.tolist()
        assert sorted(zip(-rows.score, rows.vec_id)) == list(zip(-rows.score, rows.vec_id))
    hits = sum(len(set(rows.vec_id) & set(nearest_by_hand(ids, vectors, q))) for q, rows in got.groupby("query_id"))
    assert hits / len(got) >= 0.97
    # Copies of the query: the other ones of least key, its own row out.
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(101, 121))
    assert got[got.query_id == 380].sort_values("rank").vec_id.tolist() == list(range(100, 120))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (40, None), (None, [9.0, 9.0]), (8, [1.0, 1.0, 1.0]), (60, [0.0, 0.0, 1.0]), (0, [1.0, 0.5]), (9, [1e-200, -1e-200])]
    got = nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # Two rows have key 0: each is a query, and each other's candidate.
    assert sorted(v for v, _ in by[0]) == [0, 0, 1, 1, 9, 9, 20, 20]
    assert [v for v, _ in by[20]] == [0, 0, 1, 9] and by[20][0][1] == 0.5
    assert by[60] == [(8, 1.0)] and set(by) == {0, 20, 60}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn.nearest(none).count() == 0
    assert nn.nearest(spark.createDataFrame([(20, [1.0])], none.schema)).count() == 0
    assert [tuple(r) for r in nn.nearest(spark.createDataFrame([(20, [3]), (1, [2])], "vec_id int, embedding array<int>")).collect()] == [(20, 1, 1, 6.0)]


def test_the_stop_is_a_chi_square_quantile():
    rng = np.random.default_rng(1)
    drawn = np.square(rng.standard_normal((200_000, nn.AXES))).sum(1)
    assert np.mean(drawn < nn.stretch()) == pytest.approx(nn.CHANCE, abs=0.001)
    assert nn.stretch(4, 0.5) == pytest.approx(3.3567, abs=1e-3)


def test_splits_and_tree_hold_every_point():
    rng = np.random.default_rng(2)
    at = rng.normal(size=(3000, nn.AXES))
    at[:500] = at[0]
    tree = nn.Tree(at)
    assert sorted(tree.order.tolist()) == list(range(3000)) and tree.begin[0] == 0 and tree.begin[-1] == 3000
    for a, b, lo, hi in zip(tree.begin, tree.begin[1:], tree.low, tree.high):
        assert 0 < b - a <= nn.LEAF and (at[tree.order[a:b]] >= lo).all() and (at[tree.order[a:b]] <= hi).all()
    splits = nn.Splits({3: at}, {3: 3000, 5: 10}, 300)
    where = splits.shard_of(3, at)
    assert splits.shards == len(set(where.tolist())) + 1 and np.bincount(where).max() < 1200 and splits.shard_of(5, at[:3]).tolist() == [splits.shards - 1] * 3
