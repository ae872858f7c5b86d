"""op1 on made calls; op3 against an interval join by hand over the library's own offsets."""

import json

import numpy as np
import pytest

from riskloom.llm import bpe, chat
from riskloom.llm import token_counts as tc


def test_levels_status_and_schemas(spark):
    schema = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}}, "additionalProperties": False}}
    calls = [
        (1, "a", 0, "add", '{"x": 1.0}', []),
        (1, "b", 1, "add", '{"x": "1", "y": 2}', ["a"]),
        (1, "c", 2, "none", "{}", ["a", "b", "gone"]),
        (1, "d", 3, "add", "not json", ["e"]),
        (1, "e", 4, "add", '{"x": 2}', ["d"]),
        (1, "f", 5, "add", '{"x": 2}', ["e"]),
        (1, "a", 6, "add", '{"x": 5}', []),
        (1, None, 7, "add", '{"x": 5}', None),
        (2, "a", 0, "add", None, None),
        (None, "a", 0, "add", '{"x": 5}', []),
    ]
    results = [(1, "a", 1, "one"), (1, "b", 2, None), (1, "zz", 3, "late"), (1, "a", 9, "again"), (1, "a", 9, "again")]
    df = chat.link_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        schema,
    )
    rows = df.collect()
    got = {(r.conv_id, r.call_id, r.turn): r for r in rows if r.status != "duplicate"}
    assert {k[1]: (v.level, v.status, v.n_problems) for k, v in got.items() if k[0] == 1} == {
        "a": (0, "linked", 0), "b": (1, "linked", 2), "c": (2, "unanswered", 1), "d": (None, "cyclic", 1), "e": (None, "cyclic", 0), "f": (None, "cyclic", 0), "zz": (None, "orphan", 0),
    }
    assert got[2, "a", 0].n_problems == 1
    assert sum(r.status == "duplicate" for r in rows) == 5
    assert got[1, "a", 0].message == '{"call":{"arguments":{"x":1},"name":"add"},"conversation":1,"id":"a","result":"one"}'


def test_deep_and_odd_json_stays_a_string(spark):
    deep = ["[" * n + "]" * n for n in range(100, 1200, 7)] + ['{"a":' * 990 + "1" + "}" * 990, "[" * 200_000]
    calls = spark.createDataFrame([(1, str(i), i, "any", t, None) for i, t in enumerate(deep)], "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    rows = chat.link_calls(calls, results, {"any": True}).collect()
    assert len(rows) == len(deep)
    by = {int(r.call_id): r for r in rows}
    assert by[0].n_problems == 0 and json.loads(by[0].message)["call"]["arguments"] == json.loads(deep[0])
    assert by[len(deep) - 1].n_problems == 1 and json.loads(by[len(deep) - 1].message)["call"]["arguments"] == deep[-1]


def test_schemas_of_any_legal_kind():
    assert chat.problems({"a": 1, "b": 2}, {"properties": {"a": True, "b": False}}) == ["$.b: not allowed"]
    assert chat.problems([1, "x", None], {"items": [{"type": "integer"}, {"type": "null"}]}) == ["$[1]: not null"]
    assert chat.problems(True, {"enum": [1]}) and not chat.problems(1.0, {"enum": [1]}) and not chat.problems({"z": 2}, {"additionalProperties": {"type": "number"}})
    assert chat.problems({"z": "2"}, {"additionalProperties": {"type": "number"}}) == ["$.z: not number"]
    for bad in ({"enum": 5}, {"minimum": "a"}, {"type": 3}, {"properties": {"a": 1}}, {"items": [7]}, 5, {"maxLength": True}):
        with pytest.raises(ValueError):
            chat.checked(bad)
    chat.checked(chat.REPLY["reply"])


def test_query_and_empty(spark, sf):
    rows = chat.digest(spark, sf).collect()
    turns = spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert max(r.level or 0 for r in rows) >= 2 and not any(r.status == "cyclic" for r in rows)
    assert sum(1 + (r.status == "linked") for r in rows) == turns
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    calls, results, others = chat.turns_as_calls(none)
    assert chat.link_calls(calls, results, chat.REPLY, others).count() == 0
    assert chat.canonical({"b": [1.0, float("nan")], "a": "é"}) == '{"a":"é","b":[1,null]}'


def test_tokens_of_lines(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(9000, None), (9001, ""), (9002, "\n\n\n"), (9003, "a\n\n b\n"), (9004, "é \n\n\n\n x<|endoftext|>\r\n  y"), (9004, "x\n" * 50_000)]
    got = tc.count_sections(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tok = bpe.encoder(bpe.default_path()).tokenizer
    for r in got:
        text = r.text or ""
        data, lines = text.encode(), [x.encode() for x in text.splitlines(keepends=True)] if "\r" not in text else None
        if lines is not None and not any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x85  "):
            assert [s.end - s.start for s in r.sections] == [len(x) for x in lines]
        assert r.n_tokens == len(tok.encode(text, add_special_tokens=False).ids) == sum(s.tokens for s in r.sections)
        assert b"".join(data[s.start : s.end] for s in r.sections) == data


def joined_by_hand(tok, text, spans):
    """(tokens of each section, tokens that cross): each token against every section, by the library's offsets."""
    at = np.r_[0, np.cumsum([len(c.encode()) for c in text])]
    counts, crossing = [0] * len(spans), 0
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        own = [max(0, min(at[b], e) - max(at[a], s)) for s, e in spans]
        crossing += sum(x > 0 for x in own) > 1
        counts[own.index(max(own))] += 1
    return counts, crossing


def test_sentences_against_an_interval_join_by_hand(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").limit(80).collect()]
    rows += [(9000, None), (9001, ""), (9002, "One. Two!  Three?\nFour.Five. "), (9003, "Wait... what?! \tYes.\n\n\nNo"), (9003, "Wait... what?! \tYes.\n\n\nNo"), (9004, "..."), (None, "É. è. ê")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, sections string, n_tokens int")
    got = tc.count_sections(df, by="sentence").collect()
    tok = bpe.encoder(bpe.default_path()).tokenizer
    crossed = 0
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert [s.start for s in r.sections][1:] == [s.end for s in r.sections][:-1]
        assert (r.sections[0].start, r.sections[-1].end) == (0, len(text.encode())) if text else r.sections == []
        # ASCII tokens have whole characters; others the library rounds to characters.
        if text.isascii():
            want, crossing = joined_by_hand(tok, text, [(s.start, s.end) for s in r.sections])
            assert [s.tokens for s in r.sections] == want and r.n_crossing == crossing
            crossed += crossing
        assert sum(s.tokens for s in r.sections) == r.n_tokens
    assert crossed > 100
    assert [s.end - s.start for s in next(r for r in got if r.doc_id == 9002).sections] == [5, 6, 7, 11]
    assert tc.count_sections(df.limit(0), by="sentence").count() == 0


def test_rule_for_crossing_tokens():
    edges = np.array([0, 3, 5, 9])
    first, end = np.array([0, 2, 4, 4, 9]), np.array([2, 5, 6, 9, 9])
    where, crossing = tc.allocate(first, end, edges)
    assert where.tolist() == [0, 1, 1, 2, 2] and crossing == 3
    rng = np.random.default_rng(0)
    for _ in range(50):
        edges = np.r_[0, np.unique(rng.integers(1, 60, 12)), 60]
        cuts = np.r_[0, np.unique(rng.integers(1, 60, 15)), 60]
        where, crossing = tc.allocate(cuts[:-1], cuts[1:], edges)
        inside = np.maximum(0, np.minimum(edges[None, 1:], cuts[1:, None]) - np.maximum(edges[None, :-1], cuts[:-1, None]))
        assert where.tolist() == inside.argmax(1).tolist() and crossing == ((inside > 0).sum(1) > 1).sum()


def slow_levels(needs):
    """Levels by repeated passes; needs: call -> set of calls."""
    level, todo = {}, dict(needs)
    while ready := [k for k, n in todo.items() if all(x in level for x in n if x in needs)]:
        for k in ready:
            own = [level[x] + 1 for x in todo[k] if x in needs]
            level[k] = max(own, default=0)
        for k in ready:
            del todo[k]
    return level


def test_levels_of_long_chains_and_graphs(spark):
    rng = np.random.default_rng(2)
    needs = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(600)}  # a chain
    needs |= {f"o{i}": {f"o{(i + 1) % 5}"} for i in range(5)} | {"t0": {"o0"}, "t1": {"t0"}, "s": {"s"}}  # cycles and a tail
    for i in range(60):
        needs[f"g{i}"] = {f"g{j}" for j in rng.integers(0, i, rng.integers(0, 4))} if i else {"c40"}
    needs |= {"m": {"g59", "o1"}, "n": {"m"}}
    rows = [(1, k, 0, "f", "{}", sorted(n)) for k, n in needs.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    got = {r.call_id: r.level for r in chat._levels(calls.select("conv_id", "call_id", "needs")).collect()}
    assert got == slow_levels(needs)


def test_unreadable_arguments_stay_text(spark):
    odd = ['{"x": NaN}', '{"x": 1e400}', "[" * 5000 + "]" * 5000, '{"x": ' + "[" * 900 + "]" * 900 + "}", '{"x": "\\ud800"}', '{"x": ' + "9" * 5000 + "}", ""]
    rows = [(1, str(i), i, "f" if i % 2 else "g", t, None) for i, t in enumerate(odd * 2)]
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}, "g": {"type": "no such type"}}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = chat.link_calls(calls, none, schemas).collect()
    assert len(got) == len(rows) and all(json.loads(r.message)["id"] == r.call_id for r in got)
    assert {int(r.call_id): r.n_problems for r in got}[0] == 1
