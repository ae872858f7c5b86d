"""op2 against all pairs."""

import numpy as np

from riskloom.llm import embeddings as e
from riskloom.llm.components import connected_components


def slow(rows, cosine=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    links, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (links[i], top(i)) for i, _ in rows}


def test_links_and_components(spark, sf, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 40)
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(200).collect()]
    for k in range(4):
        centre = rng.standard_normal(16)
        for _ in range(60):
            rows.append((1000 + len(rows), (centre + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])).tolist()))
    rows += [(5000 + i, rows[0][1]) for i in range(150)]
    rows += [(9000, None), (9001, []), (9002, [0.0, 0.0]), (9003, [1.0, None]), (9004, [1.0, float("nan")]), (9005, [float("inf"), 1.0]), (9006, [1.0, 2.0]), (9007, [10.0, 20.0]), (9008, [1e300, 2e300])]
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.near_vectors(df).collect()}
    want = slow([(i, v) for i, v in rows if i != 9008])
    assert got.pop(9008)[1] == 9006
    assert {k: (v[0] - (k in (9006, 9007)), v[1]) for k, v in got.items()} == want


def test_empty(spark):
    assert e.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 400)] + [(2500, 2000 + i) for i in range(0, 400)]
    odd = [(7, None), (None, 8), (9999, 9999), (5, 6), (6, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1399] == 1000 and got[2500] == 2000 and 9999 not in got


def test_recall_of_planted_pairs(spark):
    """Pairs just above the threshold among vectors that are far from all others; production parameters."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((3000, 64))
    side -= (side * x[:3000]).sum(1, keepdims=True) * x[:3000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.956, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, c * x[:3000] + np.sqrt(1 - c * c) * side]))]
    assert e.shape(len(rows))[0] >= 6
    got = {r.vec_id: r for r in e.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[9000 + i].component_id == i and got[i].n_links == 1 for i in range(3000))
    assert found >= 2995 and sum(r.n_links for r in got.values()) == 2 * found


def test_many_lengths_scales_and_repeated_keys(spark):
    rows = [(n, [float(i % 7 + 1) for i in range(n)]) for n in range(1, 1100)]
    rows += [(5000 + n, [1e-60 * float(i % 7 + 1) for i in range(n)]) for n in range(2, 1100, 50)]
    rows += [(1, [5.0, -1.0, 0.5]), (1, [-5.0, 1.0, -0.5]), (1, [5.0, -1.0, 0.5]), (None, [5.0, -1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "'x' as hash", "2 as id")
    out = e.near_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: r for r in out if r.vec_id not in (1, None)}
    for n in range(2, 1100, 50):
        assert got[5000 + n].component_id == n and got[5000 + n].n_links == 1
    assert sorted((r.n_links, r.component_id) for r in out if r.vec_id == 1) == [(0, 1), (0, 1), (1, 1), (1, 1)]
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, False)]
