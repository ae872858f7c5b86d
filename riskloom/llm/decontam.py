"""Benchmark decontamination: one Aho-Corasick automaton over the windows of
normalised benchmark items scans every text once; hits are mapped back to
offsets of the original text."""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, store, texts

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes some 430 times as much memory in each
#: worker (each word opens ten patterns, each character a node). A larger benchmark is cut
#: into several automata by item, each of which scans the texts.
AUTOMATON_BYTES = 1_000_000

#: Word bytes keep their value (A-Z lowered), all others become a space.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def automaton(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton | None:
    """Patterns are windows with a space at either end; values (words, item numbers)."""
    found: dict[bytes, tuple[int, set[int]]] = {}
    for k, (_, text) in enumerate(items):
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found.setdefault(b" ".join(w[i : i + n]), (n, set()))[1].add(k)
    if not found:
        return None
    made = ahocorasick.Automaton()
    for text, (n, who) in found.items():
        made.add_word(f" {text.decode('latin-1')} ", (n, tuple(who)))
    made.make_automaton()
    return made


_BUILT: dict[str, object] = {}


def _cached(key: str, build):
    """One automaton per worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the word ranges [start, end), as sorted disjoint ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def _scan(text: bytes, made) -> tuple[int, list, list, list]:
    """(number of words, first hit words, ends, item numbers)."""
    w = words(text)
    if made is None or not w:
        return len(w), [], [], []
    line = b" " + b" ".join(w) + b" "
    hits = list(made.iter(line.decode("latin-1")))
    if not hits:
        return len(w), [], [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    starts, ends = _runs(ends - np.array([n for _, (n, _) in hits]), ends)
    return len(w), starts.tolist(), ends.tolist(), sorted({k for _, (_, who) in hits for k in who})


def _offsets(text: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Word ranges as code-point ranges of the original text."""
    code = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(_TO_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    points = np.r_[0, np.cumsum((code & 0xC0) != 0x80)]
    return points[edge[0::2][starts]].tolist(), points[edge[1::2][np.array(ends) - 1]].tolist()


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _scan_frame(docs: DataFrame, items: list[tuple[str, bytes]], window: int, text: str, keep: list[str]) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def make():
        made = _cached(key, lambda: automaton(shared.value, window))
        names = [i for i, _ in shared.value]

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            n, hit, spans, found = [], [], [], []
            for t in texts(batch, text):
                k, s, e, who = _scan(t, made)
                n.append(k)
                hit.append([{"first": x, "end": y} for x, y in zip(s, e)])
                spans.append([{"start": x, "end": y} for x, y in zip(*_offsets(t, s, e))] if s else [])
                found.append(sorted({names[x] for x in who} - {None}))
            pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
            return [pa.array(n, pa.int64()), pa.array(hit, pair("first", "end")), pa.array(spans, pair("start", "end")), pa.array(found, pa.list_(pa.string()))]

        return fn

    return append_columns(docs, make, _FIELDS, keep)


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", keep: list[str] | None = None, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Rows of docs with n_words, hit_words (ranges of word numbers), hit_spans
    (code-point ranges of the original text) and items (ids as strings, sorted).

    Null and empty texts have no words and no hits; items without words match
    nothing; repeated items each count; an item whose id is null hits, and is left
    out of items. Input columns
    named like a result are replaced. Only the benchmark is broadcast: its size
    is summed first, and beyond automaton_bytes it is dealt into parts by item.
    """
    asked = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    keep = docs.columns if keep is None else keep
    if parts == 1:
        return _scan_frame(docs, [(r[0], bytes(r[1])) for r in asked.collect()], window, text, keep)
    # A benchmark beyond one automaton: hits of each part are written, then merged by row.
    new = {f.name for f in _FIELDS}
    kept = [c for c in keep if c not in new]
    row_id = next(n for i in range(len(docs.columns) + 1) if (n := f"_row{i}") not in docs.columns)
    rows = store(docs.select(*dict.fromkeys([*kept, text])).withColumn(row_id, F.expr("uuid()")), "decontam-rows")
    found = None
    for part in range(parts):
        mine = asked.where(F.expr(f"pmod(xxhash64(item_id, text), {parts}) = {part}"))
        hits = store(_scan_frame(rows.df, [(r[0], bytes(r[1])) for r in mine.collect()], window, text, [row_id]), "decontam-hits")
        found = hits.df if found is None else found.unionByName(hits.df)
    merged = found.groupBy(row_id).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hit_words")).alias("hit_words"),
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    for name, a, b in (("hit_words", "first", "end"), ("hit_spans", "start", "end")):
        merged = merged.withColumn(name, F.expr(_UNION.format(x=name, a=a, b=b)))
    return rows.df.select(row_id, *kept).join(merged, row_id).drop(row_id)


#: Sorted disjoint union of an array of ranges.
_UNION = (
    "aggregate(array_sort({x}), cast(array() as array<struct<{a}:bigint,{b}:bigint>>), (acc, r) -> "
    "if(size(acc) > 0 and element_at(acc, -1).{b} >= r.{a}, "
    "concat(slice(acc, 1, size(acc) - 1), array(named_struct('{a}', element_at(acc, -1).{a}, '{b}', greatest(element_at(acc, -1).{b}, r.{b})))), "
    "concat(acc, array(r))))"
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs without the rows in which a window of a benchmark item occurs; columns unchanged."""
    cols = [c for c in docs.columns]
    seen = scan_benchmark(docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(cols)]), benchmark, window, f"in_{cols.index(text)}")
    clean = seen.where(F.size("hit_words") == 0)
    return clean.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(cols)])


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op10_decontamination."""
    from .common import table

    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    seen = scan_benchmark(docs, bench, keep=["doc_id"])
    n_hit = F.expr("aggregate(hit_words, 0L, (s, r) -> s + r.end - r.first)")
    return seen.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id::varchar as item, {_SQL_WORDS} as w from benchmark where text is not null),
n as (select item, w, least({WINDOW}, len(w)) as n from b where len(w) > 0),
bw as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from n)),
p as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from d),
l as (select doc_id, i, [w, {', '.join(f'lead(w, {k}) over (partition by doc_id order by i)' for k in range(1, WINDOW))}] as l from p),
dw as (select doc_id, i, s.n, array_to_string(l[1 : s.n], ' ') as win from l, (select distinct n from bw) s where l[s.n] is not null),
h as (select doc_id, i, dw.n, item from dw join bw on dw.win = bw.win and dw.n = bw.n),
c as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h where item is not null) group by doc_id)
select d.doc_id, coalesce(len(d.w), 0)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
