"""op4 against a table of all windows; loser tree and coding on their own."""

import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import repeats as r


def slow(rows):
    seen, cover = {}, {}
    for k, t in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0])):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - r.W + 1):
            w = t[p : p + r.W]
            if w in seen:
                gone[p : p + r.W] = b"\1" * r.W
            else:
                seen[w] = 1
        cover[k] = bytes(b for b, g in zip(t, gone) if not g), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__()
    return cover


def compare(spark, rows):
    got = r.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = slow(rows)
    assert len(got) == len(rows)
    for g in got:
        kept, removed, spans = want[g.doc_id]
        assert (bytes(g.kept), g.n_removed, g.n_spans) == (kept, removed, spans), g.doc_id
    return want


def test_documents(spark, sf):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sum(v[1] for v in compare(spark, rows).values()) > 0


def test_made_texts(spark, monkeypatch):
    monkeypatch.setattr(r, "HOT", 2)
    random.seed(4)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = text(60)
    rows = [(1, "a" * 5000), (2, "ab" * 700), (3, "a" * 99), (4, "a" * 100), (5, None), (6, ""), (7, common), (8, common), (None, common[:150])]
    for i in range(60):
        a, b = sorted(random.sample(range(len(common)), 2))
        rows.append((100 + i, text(random.randint(0, 40)) + common[a:b] + text(random.randint(0, 30)) + (common if i % 3 else "")))
    rows.append((500, rows[20][1] * 3))
    compare(spark, rows)


def test_pieces_of_long_texts_agree(monkeypatch):
    monkeypatch.setattr(r, "PIECE", 700)
    random.seed(5)
    own = [bytes(random.choice(b"abc ") for _ in range(n)) for n in (99, 100, 101, 700, 799, 800, 5000, 0)]
    starts = 0
    for text, doc, first, last, off in r.pieces(list(range(len(own))), own):
        start, end, o, a, h, g = r.segments(text, first, last, (4, 5))
        assert len(np.unique(h ^ g)) == len(np.unique(h)) == len(np.unique(g))
        starts += int((end - start).sum())
        assert ((o >= end - 1 - start) & (o < r.SPAN)).all()
        for s, e in zip(start, end):
            p = max(i for i in range(len(first)) if first[i] <= s)
            assert e <= last[p] and own[doc[p]][s + off[p] : e + 99 + off[p]] == text[s : e + 99].tobytes()
    assert starts == sum(max(0, len(t) - 99) for t in own)


def test_front_coding_and_merge():
    random.seed(6)
    runs = [sorted(bytes(random.choice(b"ab") for _ in range(random.randint(0, 12))) for _ in range(random.randint(0, 60))) for _ in range(7)]
    decoded = [[s for s, _ in r.front_decode(*r.front_code(x))] for x in runs]
    assert decoded == runs
    tree = r.LoserTree([r.front_decode(*r.front_code(x)) for x in runs])
    out = list(tree)
    assert [s for s, _, _ in out] == sorted(sum(runs, []))
    for (s, _, _), (t, k, _) in zip(out, out[1:]):
        assert k == r.lcp(s, t)
    total = sum(len(s) for s, _, _ in out)
    assert tree.compared < 3 * total
    assert list(r.LoserTree([])) == []


def test_empty_and_short(spark):
    assert r.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = r.cut_repeats(spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string")).collect()
    assert all(g.n_removed == 0 and bytes(g.kept) == b"short" for g in got)


def test_rows_that_repeat_a_key(spark):
    """Each row is a document of its own; among equal keys the order is that of a hash of the text."""
    random.seed(9)
    text = lambda n: " ".join(str(random.random()) for _ in range(n))
    common, other = text(20), text(20)
    rows = [(7, common), (7, common + " end"), (7, "short"), (7, text(30)), (7, common), (None, other), (None, other + text(3)), (None, None), (3, text(5) + other[:200]), (9, other), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    hashes = [r_.h for r_ in df.select(F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("h")).collect()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashes[i]))
    want = slow([(at, rows[i][1]) for at, i in enumerate(order)])
    got = sorted((g.doc_id or -1, bytes(g.kept), g.n_removed, g.n_spans) for g in r.cut_repeats(df).collect())
    assert got == sorted((rows[i][0] or -1, *want[at]) for at, i in enumerate(order))


def test_parts_follow_the_bytes(spark, sf, monkeypatch):
    monkeypatch.setattr(r, "PART", 20_000)
    monkeypatch.setattr(r, "SAMPLE", 50)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    compare(spark, rows)
