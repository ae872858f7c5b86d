"""Stages of the pipeline against brute force."""

import random
import re

import corpus_pipeline
from riskloom.llm import decontam, lines, overlap


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def slow_groups(rows, similarity=0.8):
    sets = {k: shingles(t) for k, t in rows if k is not None}
    sets = {k: s for k, s in sets.items() if s}
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: top(k) for k in ids}


def test_groups_of_near_copies(spark, sf, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD", 40)
    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    words = [w for _, t in docs for w in t.split()]
    base = " ".join(rng.sample(words, 300))
    for i in range(150):
        w = base.split()
        for at in rng.sample(range(len(w)), rng.choice([1, 3, 6, 7, 8, 12, 30])):
            w[at] = rng.choice(words)
        docs.append((10_000 + i, " ".join(w)))
    docs += [(20_000, None), (20_001, ""), (20_002, "Four words are here"), (20_003, "four WORDS are here"), (None, base)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.component for r in overlap.groups(df).collect()}
    want = slow_groups(docs)
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) == 0
    kept = {r.doc_id for r in overlap.keep_one(df).collect()}
    assert kept == {k for k, v in want.items() if k == v} | {20_000, 20_001, None}


def test_recall_of_pairs_at_the_threshold(spark, sf, monkeypatch):
    """Pairs alone in their group, with an overlap of 0.8 to 0.83; also in tiny sets, and with shards cut in parts."""
    monkeypatch.setattr(overlap, "SHARD", 64)
    monkeypatch.setattr(overlap, "PER_SHARD", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for i in range(300):
        n = rng.choice([8, 9, 30, 100, 400])
        base = rng.choices(words, k=n)
        # Words put at the end: n - 4 shingles of n - 4 + more stay common.
        more = int((n - 4) / 0.8 + 1e-9) - (n - 4)
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + rng.choices(words, k=more)))]
    got = {r.id: r.component for r in overlap.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = slow_groups(docs)
    pairs = [k for k in want if want[k] != k]
    assert len(pairs) > 250
    assert sum(got[k] == want[k] for k in pairs) >= 0.96 * len(pairs)
    assert all(got[k] in (k, want[k]) for k in want)


def test_large_family_costs_rows_in_proportion(spark, monkeypatch):
    """A component that fills a shard meets the rest, not itself."""
    from riskloom.llm.common import deal_apart

    rows = spark.range(1000).selectExpr("id as node", "0 as band", "if(id < 900, 1L, id) as component")
    dealt = deal_apart(rows, ["band"], "component", "node", 50).toPandas()
    assert (dealt.node < 900).sum() == 900 * 2 and len(dealt) < 900 * 2 + 100 * 21
    blocks = {k: set(g.node) for k, g in dealt.groupby(["part_a", "part_b"])}
    met = {(a, b) for nodes in blocks.values() for a in nodes for b in nodes if a < b and b >= 900}
    assert len(met) == 900 * 100 + 100 * 99 // 2


def test_near_copies_of_rows_that_repeat_a_key(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:60]), " ".join(words[60:130])
    docs = [(3, a), (5, a + " end"), (5, b), (5, b), (7, b + " end"), (9, None), (9, None)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, id string")
    kept = sorted((r.doc_id, r.text or "") for r in overlap.keep_one(df).collect())
    assert kept == [(3, a), (5, b), (9, ""), (9, "")]
    assert overlap.keep_one(df.limit(0)).count() == 0 and overlap.keep_one(df).columns == df.columns


def test_lines_against_brute_force(spark):
    docs = [(i, f"Menu\nText number {i} alone\n  Menu \n\nEnd {i % 2}", "a", "x" if i < 40 else None) for i in range(60)]
    docs += [(100 + i, f"Menu\nrare {i}", "b", "y") for i in range(4)] + [(200, None, "a", "x"), (201, "", "a", "x"), (200, None, "a", "x"), (None, "Menu\nno key", "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, gone string, source string")
    out = lines.drop_boilerplate(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in out.collect())
    want = []
    for k, t, _, s in docs:
        if t is not None and s != "y":
            t = "\n".join(x for x in t.split("\n") if not (x.strip() == "Menu" or (k is not None and k < 60 and x.startswith("End"))))
        want.append((k is None, k, t))
    assert got == sorted(want)


def test_decontamination_against_brute_force(spark, sf):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "Short item"), (901, None), (902, "!!"), (None, "no id at all in here"), (900, "another one of it")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9000, None), (9001, ""), (9002, "A SHORT, item! and short-item"), (9003, "Éa short item é" + " x" * 50_000), (9004, "but no ID at all in here")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in bench:
        w = split(t)
        for i in range(max(0, len(w) - 9) if len(w) >= 10 else bool(w)):
            windows.setdefault(tuple(w[i : i + 10]), set()).update([str(k)] * (k is not None))
    sizes = {len(w) for w in windows}
    want = {}
    for k, t in docs:
        w, hit, items = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= who
        want[k] = len(w), len(hit), sorted(items)
    assert any(v[1] for v in want.values())
    assert want[9004] == (7, 6, [])
    d, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as _row0"), spark.createDataFrame(bench, "item_id long, text string")
    for size in (8_000_000, 2_000):
        rows = decontam.scan_benchmark(d, b, automaton_bytes=size).collect()
        assert {r.doc_id: (r.n_words, sum(h.end - h.first for h in r.hit_words), list(r["items"])) for r in rows} == want
        for r in rows:
            assert [split((r.text or "")[s.start : s.end]) for s in r.hit_spans] == [split(r.text)[h.first : h.end] for h in r.hit_words]
    assert decontam.scan_benchmark(d, b).columns[:3] == ["doc_id", "text", "_row0"] and decontam.scan_benchmark(d.limit(0), b).count() == 0
    assert decontam.scan_benchmark(d, b.limit(0)).where("size(items) > 0").count() == 0
    assert {r.doc_id for r in decontam.decontaminate(d, b).collect()} == {k for k, v in want.items() if not v[1]}


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_lines_and_benchmark_on_empty_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    none = docs.limit(0)
    assert lines.drop_boilerplate(none).count() == 0 and lines.drop_boilerplate(none).columns == docs.columns
    assert decontam.decontaminate(none, items).count() == 0
    few = docs.orderBy("doc_id").limit(5)
    assert decontam.decontaminate(few, items.limit(0)).count() == 5
