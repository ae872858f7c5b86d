"""op11 against counting by hand: phrases, cuts, absorbed phrases, ranges and odd rows."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from riskloom.llm import collocations as co
from riskloom.llm.collocations import Trie, collocations, phrase_counts, words_of


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower)]


def counted(rows):
    """{lang: Counter of phrases of 1 to 4 words}"""
    out = {}
    for lang, text in rows:
        f = out.setdefault("und" if lang is None else lang, Counter())
        for w in pieces(text):
            for n in range(1, 5):
                f.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def brute(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(v for p, v in f.items() if " " not in p)
        cand = {p: a for p, a in f.items() if " " in p and a >= least}
        gone = {p for p, a in cand.items() for q, b in cand.items() if q.count(" ") > p.count(" ") and f" {p} " in f" {q} " and 100 * b >= 80 * a}
        best = []
        for p, a in cand.items():
            if p in gone:
                continue
            w = p.split(" ")
            cuts = [(2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best.append((-score, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, i, p, a, l, r, n, -s) for i, (s, _, _, p, a, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def text(rng, words, n):
    return "".join(rng.choices(words, k=1)[0] + rng.choices([" ", "  ", "\t", ". ", ",", "\n"], [20, 1, 1, 2, 1, 1])[0] for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["The", "of", "naïve", "ÉTÉ", "x-1", "'a'", "zu", "b", "c", "d"]
    out = [(rng.choice(["en", "fr", None, "und"]), text(rng, words, rng.randrange(0, 80))) for _ in range(150)]
    hot = [("en", "one very common pair " + " ".join(rng.choices(words, k=3))) for _ in range(120)]
    return [*out, *hot, ("en", None), ("fr", ""), ("en", " \t "), ("en", "...,,"), *[("de", "same words here again")] * 40]


def test_words_and_pieces_by_hand():
    texts = ["A b.c", "", "É\tD,\x0be  f", "g"]
    words, piece, text_of = words_of([t.encode() for t in texts])
    want = [(w, k) for k, t in enumerate(texts) for p in pieces(t) for w in p]
    assert [(w.decode(), int(k)) for w, k in zip(words.to_pylist(), text_of)] == want
    runs = [len(p) for t in texts for p in pieces(t) if p]
    assert [len([x for x in piece if x == v]) for v in dict.fromkeys(piece.tolist())] == runs


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_tries_cut_packed_and_merged_count_as_one(rows, ranges):
    some = [(lang or "und", (t or "").encode()) for lang, t in rows]
    whole = Trie.of([a for a, _ in some], [t for _, t in some])
    paths = sorted((a.encode(), *[w.encode() for w in p.split(" ")]) for a, f in counted(rows).items() for p in f)
    bounds = sorted({paths[len(paths) * k // ranges] for k in range(1, ranges)})
    parts: dict[int, list] = {}
    for s in range(4):
        for r, t in Trie.of([a for a, _ in some[s::4]], [t for _, t in some[s::4]]).cut(bounds):
            parts.setdefault(r, []).append(Trie.unpack(pa.py_buffer(t.pack())))
    got, total, want = Counter(), Counter(), counted(rows)
    for r in parts.values():
        merged = Trie.merged(r)
        for b in merged.frequent(5):
            for row in b.to_pylist():
                assert (row["lang"], row["phrase"]) not in got
                got[row["lang"], row["phrase"]] = row["f"]
                w = row["phrase"].split(" ")
                # A walk up finds the counts of the first words, wherever the range was cut.
                assert row["left"] == [want[row["lang"]][" ".join(w[:k])] for k in range(1, len(w))]
        for row in merged.totals().to_pylist():
            total[row["lang"]] += row["f"]
    assert got == {(a, p): n for a, f in want.items() for p, n in f.items() if n >= 5}
    assert {k: v for k, v in total.items() if v} == {a: sum(v for p, v in f.items() if " " not in p) for a, f in want.items() if f}
    assert whole.nodes == sum(len(f) for f in want.values())


def test_collocations_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "RANGE_BYTES", 600)
    monkeypatch.setattr(co, "SHARD_BYTES", 900)
    df = spark.createDataFrame([(i, a, t, "x", 1, 2) for i, (a, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int, rank int").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, least=6, top=15).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, 6, 15)
    assert any(r[0] == "de" and r[2] == "same words here again" for r in got)  # its parts are inside it


def test_empty_tables_and_one_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(none).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None), (2, "en", "")], none.schema)).count() == 0
    long = spark.createDataFrame([(1, "en", "to be or not " * 50_000)], none.schema)
    got = {r.phrase: r for r in collocations(long).collect()}
    assert set(got) == {"to be or not", "be or not to", "or not to be", "not to be or"} and got["to be or not"].a == 50_000
    assert {r.depth for r in phrase_counts(long).collect()} == {0, 1, 2, 3, 4}
