"""Phrase collocation mining: depth-limited count tries a shard, serialised sorted,
cut at the bounds of prefix ranges and merged range by range.

A trie has one level a phrase length; a node is its parent and its last word. The
count of a phrase's first words is that of an ancestor, found by walking up; that
of its last words is behind suffix links, which cross ranges and are resolved by a
join of the frequent nodes with themselves. A phrase that is frequent enough has
only frequent parts, so nothing below the threshold leaves its range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, shuffle_partitions, store

DEPTH, LEAST, TOP, UNKNOWN = 4, 30, 2000, "und"
#: A longer phrase with at least so many hundredths of a candidate's occurrences takes its place.
ABSORBED = 80
#: Bytes of text behind one trie of a shard, and behind a range on average.
SHARD_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Ranges at most (their bounds stand on the driver and in each task), and keys drawn for each.
RANGES, DRAWN = 65536, 16
#: Nodes waiting in a range before they are merged.
WAITING = 2_000_000

#: What ends a piece, and what parts words within one.
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CLASS = np.array([2 if c in _BREAKS else 1 if c in _GAPS else 0 for c in range(256)], np.uint8)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, piece of each, text of each): the lower-cased words of all texts in order; pieces don't cross texts."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[joined]
    inside = np.r_[False, kind == 0]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    data = _LOWER[joined[kind == 0]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return words, piece, np.searchsorted(begin, starts, "right") - 1


def _sorted(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in byte order, and for each value its place among them."""
    coded = pc.dictionary_encode(values)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary.take(pa.array(order)), rank[codes]


class Trie:
    """langs and words in byte order; for each level the parent (of the first: the
    language), word and count of its nodes, by parent and word. The first `lead[d]`
    nodes of a level (0 or 1) stand for an ancestor that belongs to an earlier range."""

    def __init__(self, langs: pa.Array, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lead: list[int] | None = None):
        self.langs, self.words, self.levels, self.lead = langs, words, levels, lead or [0] * DEPTH

    @property
    def nodes(self) -> int:
        return sum(len(w) for _, w, _ in self.levels)

    @staticmethod
    def of(langs: list[str], texts: list[bytes]) -> Trie:
        words, piece, text = words_of(texts)
        names, lang = _sorted(pa.array(langs, pa.large_string()).cast(pa.large_binary()))
        vocabulary, word = _sorted(words)
        size = max(len(vocabulary), 1)
        levels, node, at = [], lang[text], np.arange(len(word))
        for d in range(DEPTH):
            if d:
                stays = (at + d < len(word)) & (piece[np.minimum(at + d, len(word) - 1)] == piece[at]) if len(at) else np.zeros(0, bool)
                at, node = at[stays], node[stays]
            keys, node, counts = np.unique(node * size + word[at + d], return_inverse=True, return_counts=True)
            levels.append((keys // size, keys % size, counts))
        return Trie(names, vocabulary, levels)

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        """Sum of tries of one range: sorted runs merged level by level."""
        if len(tries) == 1:
            return tries[0]
        names, lang = _sorted(pa.concat_arrays([t.langs for t in tries]))
        words, rank = _sorted(pa.concat_arrays([t.words for t in tries]))
        up = np.split(lang, np.cumsum([len(t.langs) for t in tries])[:-1])
        own = np.split(rank, np.cumsum([len(t.words) for t in tries])[:-1])
        size, levels, lead = max(len(words), 1), [], []
        for d in range(DEPTH):
            runs = [up[i][t.levels[d][0]] * size + own[i][t.levels[d][1]] for i, t in enumerate(tries)]
            keys, counts = np.concatenate(runs), np.concatenate([t.levels[d][2] for t in tries])
            order = np.argsort(keys, kind="stable")  # a merge of runs: each is sorted
            at = keys[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            kept = at[first]
            levels.append((kept // size, kept % size, np.add.reduceat(counts[order], first) if len(first) else counts))
            lead.append(max(t.lead[d] for t in tries))
            up = [np.searchsorted(kept, r) for r in runs]
        return Trie(names, words, levels, lead)

    def cut(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Trie]]:
        """(range, sub-trie) where a range has nodes; bounds are paths (language, words), in order.

        A node lies in the range of its own path, a path before its extensions. Ancestors
        of a bound come along with their count, so that every walk up ends in its range.
        """
        size, n = max(len(self.words), 1), len(bounds)
        vocabulary = {w: i for i, w in enumerate(sorted({w for b in bounds for w in b[1:]}))}
        wanted = pa.array(list(vocabulary), pa.large_binary())
        lower, known = _places(self.words, wanted)
        lang_lower, lang_known = _places(self.langs, pa.array([b[0] for b in bounds], pa.large_binary()))
        up, on_path = lang_lower.copy(), lang_known.copy()
        begins, leads = [], []
        for d in range(DEPTH):
            parent, word, _ = self.levels[d]
            keys = parent * size + word
            deep = np.array([len(b) - 1 for b in bounds]) if n else np.zeros(0, np.int64)
            index = np.array([vocabulary[b[d + 1]] if d + 1 < len(b) else 0 for b in bounds], np.int64)
            here = on_path & (deep > d)
            rank = lower[index] if len(wanted) else np.zeros(n, np.int64)
            p = np.searchsorted(keys, up * size + np.where(here, rank, 0))
            same = here & (known[index] if len(wanted) else False) & (p < len(keys))
            same &= keys[np.minimum(p, max(len(keys) - 1, 0))] == up * size + rank if len(keys) else False
            begins.append(p + (same & (deep > d + 1)))
            leads.append(same & (deep > d + 1))
            up, on_path = p, same
        begins = [np.r_[0, b, len(self.levels[d][1])].astype(np.int64) for d, b in enumerate(begins)]
        leads = [np.r_[False, x] for x in leads]
        for r in range(n + 1):
            lead = [int(leads[d][r]) for d in range(DEPTH)]
            span = [(int(begins[d][r]) - lead[d], int(max(begins[d][r + 1], begins[d][r]))) for d in range(DEPTH)]
            if any(hi > lo for lo, hi in span):
                yield r, self._part(span, lead)

    def _part(self, span: list[tuple[int, int]], lead: list[int]) -> Trie:
        cut = [tuple(x[lo:hi] for x in level) for level, (lo, hi) in zip(self.levels, span)]
        used = np.unique(np.concatenate([w for _, w, _ in cut]))
        base = [0] + [lo for lo, _ in span[:-1]]
        levels = [(p - base[d], np.searchsorted(used, w), c) for d, (p, w, c) in enumerate(cut)]
        return Trie(self.langs, self.words.take(pa.array(used)), levels, lead)

    def pack(self) -> bytes:
        """Sorted and small: steps between parents, words, counts, each in the least width."""
        parts = [np.array(self.lead, np.uint8).tobytes()]
        for values in (self.langs, self.words):
            lengths = pc.binary_length(values).to_numpy(zero_copy_only=False)
            parts += [_narrow(lengths), b"".join(values.to_pylist())]
        for parent, word, count in self.levels:
            parts += [_narrow(np.diff(parent, prepend=0)), _narrow(word), _narrow(count)]
        sizes = struct.pack(f"<{len(parts)}q", *map(len, parts))
        return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))

    @staticmethod
    def unpack(blob: bytes) -> Trie:
        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        n = 5 + 3 * DEPTH
        ends = np.cumsum(struct.unpack(f"<{n}q", raw[: 8 * n])) + 8 * n
        part = [raw[a:b] for a, b in zip(np.r_[8 * n, ends[:-1]].tolist(), ends.tolist())]
        values = []
        for lengths, data in (part[1:3], part[3:5]):
            offsets = np.r_[0, np.cumsum(_wide(lengths))].astype(np.int64)
            values.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(bytes(data))]))
        levels = [(np.cumsum(_wide(p)), _wide(w), _wide(c)) for p, w, c in zip(part[5::3], part[6::3], part[7::3])]
        return Trie(*values, levels, list(part[0]))

    def frequent(self, least: int) -> Iterator[pa.RecordBatch]:
        """Nodes of this range with at least `least` occurrences: lang, depth, phrase, f, and f of its first 1, 2, .. words."""
        kept_up = np.arange(len(self.langs))
        phrase, lang, before = None, kept_up, []
        for d, (parent, word, count) in enumerate(self.levels):
            keep = count >= least
            at = kept_up[parent[keep]]  # parents of frequent nodes are frequent
            last = self.words.take(pa.array(word[keep]))
            phrase = last if phrase is None else pc.binary_join_element_wise(phrase.take(pa.array(at)), last, pa.scalar(b" ", pa.large_binary()))
            lang, before = lang[at], [b[at] for b in before] + ([own[at]] if d else [])
            own = count[keep]
            kept_up = np.cumsum(keep) - 1
            mine = slice(1, None) if self.lead[d] and keep[:1].any() else slice(0, None)
            n = len(own[mine])
            left = np.stack([b[mine] for b in before], 1).ravel() if before else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
            yield pa.RecordBatch.from_arrays(
                [
                    self.langs.take(pa.array(lang[mine])).cast(pa.large_string()).cast(pa.string()),
                    pa.array(np.full(n, d + 1, np.int32)),
                    phrase[mine].cast(pa.large_string()).cast(pa.string()),
                    pa.array(own[mine]),
                    pa.ListArray.from_arrays(offsets, pa.array(left)),
                ],
                _NODES,
            )

    def totals(self) -> pa.RecordBatch:
        """Word occurrences of each language in this range, as nodes of depth 0."""
        parent, _, count = (x[self.lead[0] :] for x in self.levels[0])
        sums = np.bincount(parent, count, len(self.langs)).astype(np.int64) if len(parent) else np.zeros(len(self.langs), np.int64)
        n = len(sums)
        left = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))
        return pa.RecordBatch.from_arrays([self.langs.cast(pa.large_string()).cast(pa.string()), pa.array(np.zeros(n, np.int32)), pa.array([""] * n), pa.array(sums), left], _NODES)


_NODES = ["lang", "depth", "phrase", "f", "left"]
_NODE_TYPES = "lang string, depth int, phrase string, f long, left array<long>"


def _places(among: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted value its lower bound among sorted distinct values, and whether it is there."""
    both = pa.concat_arrays([among, wanted])
    distinct, rank = _sorted(both)
    own, asked = rank[: len(among)], rank[len(among) :]
    at = np.searchsorted(own, asked)
    return at, (own[np.minimum(at, len(own) - 1)] == asked) if len(own) else np.zeros(len(asked), bool)


def _narrow(x: np.ndarray) -> bytes:
    """A width byte and the numbers in the least unsigned width that holds them."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: memoryview) -> np.ndarray:
    return np.frombuffer(data[1:], f"<u{data[0]}").astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts) of some SHARD_BYTES."""
    langs, held, n = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
            langs.append(lang)
            held.append(text)
            n += len(text)
            if n >= SHARD_BYTES:
                yield langs, held
                langs, held, n = [], [], 0
    if held:
        yield langs, held


def range_bounds(docs: DataFrame, ranges: int, stride: int) -> list[tuple[bytes, ...]]:
    """Paths that cut the phrases of docs (lang, text) into ranges of about equal size: quantiles of every stride-th word's phrase."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, held in _blocks(batches):
            words, piece, text = words_of(held)
            at = np.arange(min(len(held[0]), stride - 1) % stride, len(words), stride)
            path = [pa.array([langs[i] for i in text[at]], pa.string())]
            for d in range(DEPTH):
                inside = (at + d < len(words)) & (piece[np.minimum(at + d, len(words) - 1)] == piece[at]) if len(at) else np.zeros(0, bool)
                path.append(words.take(pa.array(np.where(inside, at + d, 0), mask=~inside)).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(path, ["lang", "w0", "w1", "w2", "w3"])

    drawn = docs.mapInArrow(draw, "lang string, w0 binary, w1 binary, w2 binary, w3 binary").collect()
    paths = sorted((r.lang.encode(), *[bytes(w) for w in r[1:] if w is not None]) for r in drawn)
    return sorted({paths[len(paths) * k // ranges] for k in range(1, ranges)}) if len(paths) >= ranges else []


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, depth, phrase, f, left) of every phrase of 1 to 4 words with at least `least`
    occurrences; left: f of its first 1, 2, .. words. Rows of depth 0 add up to a language's words.

    Null texts are empty, a null language is `und`, rows that repeat count each.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(RANGES, -(-size // RANGE_BYTES)))
    # Bounds only balance: a word has 2 bytes at least, so at most ranges * DRAWN * 3 paths come to the driver.
    bounds = range_bounds(rows, ranges, max(1, size // (6 * ranges * DRAWN))) if ranges > 1 else []
    at = docs.sparkSession.sparkContext.broadcast(bounds)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, held in _blocks(batches):
            for r, part in Trie.of(langs, held).cut(at.value):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part.pack()], pa.binary())], ["range", "trie"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Trie] = []
        now, waiting = None, 0
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if r != now and held:
                    yield from _done(Trie.merged(held), least)
                    held, waiting = [], 0
                now = r
                held.append(Trie.unpack(blob.as_buffer()))
                waiting += held[-1].nodes
                if waiting >= WAITING:
                    held, waiting = [Trie.merged(held)], 0
        if held:
            yield from _done(Trie.merged(held), least)

    shards = rows.mapInArrow(build, "range int, trie binary")
    parts = min(max(len(bounds) + 1, 1), max(shuffle_partitions(docs.sparkSession), -(-len(bounds) // 8)))
    # Ranges go round the partitions, so that neighbours under one common word don't meet in a task.
    return shards.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(merge, _NODE_TYPES)


def _done(trie: Trie, least: int) -> Iterator[pa.RecordBatch]:
    yield trie.totals()
    yield from trie.frequent(least)


#: Copies of a suffix's count, by its words: many candidates end with one word.
_SPREAD = {1: 32, 2: 8}


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    score is floor(2000000 a / (l + r)) at the cut with the least score, of these the
    first. A phrase inside a longer one with at least 80 % of its occurrences is
    left out. Null texts are empty, a null language is `und`; an empty table gives
    no rows, rows that repeat count each.
    """
    nodes = store(phrase_counts(docs, lang, text, least), "phrases").df
    n = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    found = nodes.where("depth >= 2")
    cuts = found.select("lang", "phrase", "depth", F.col("f").alias("a"), F.posexplode("left").alias("k", "l"))
    cuts = cuts.withColumn("suffix", F.expr("substring_index(phrase, ' ', k + 1 - depth)"))
    spread = lambda words: F.when(words == 1, _SPREAD[1]).when(words == 2, _SPREAD[2]).otherwise(1)
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), spread(F.col("depth") - F.col("k") - 1)).cast("int"))
    ends = nodes.where(f"depth between 1 and {DEPTH - 1}").select("lang", F.col("phrase").alias("suffix"), F.col("f").alias("r"), F.explode(F.sequence(F.lit(0), spread(F.col("depth")) - 1)).alias("salt"))
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    # Merged: Spark takes a table after explode to be as small as before it, and would send millions of rows through the driver.
    scored = cuts.join(ends.hint("merge"), ["lang", "suffix", "salt"]).groupBy("lang", "phrase").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r", "a")).alias("best"))
    words = F.split("phrase", " ")
    inner = lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    parts = F.when(F.size("w") == 3, inner(2)).otherwise(F.concat(inner(2), inner(3)))
    longer = nodes.where("depth >= 3").select("lang", "f", words.alias("w")).select("lang", "f", F.explode(parts).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = scored.join(longer.hint("merge"), ["lang", "phrase"], "left").where(f"longest is null or cast(longest as decimal(20, 0)) * 100 < cast(best.a as decimal(20, 0)) * {ABSORBED}")
    kept = kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession))))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op11_phrase_collocations."""
    from .common import table

    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
with pieces as (
  select doc_id, coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents where text is not null
), tokens as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
placed as (select lang, w, unnest(range(1, len(w) + 1)) as i from tokens where len(w) > 0),
grams as (
  select lang, k as depth, array_to_string(w[i:i + k - 1], ' ') as phrase from placed, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w)
), f as materialized (select lang, depth, phrase, count(*) as f from grams group by all having depth = 1 or count(*) >= {LEAST}),
n as (select lang, sum(f)::bigint as n from f where depth = 1 group by lang),
cand as (select lang, phrase, depth, f as a, string_split(phrase, ' ') as w from f where depth >= 2 and f >= {LEAST}),
cuts as (select *, unnest(range(1, depth)) as k from cand),
scored as (
  select c.lang, c.phrase, c.w, c.k, c.a, l.f as l, r.f as r, (2000000::hugeint * c.a // (l.f + r.f))::bigint as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, a, array_to_string(w[i:i + size - 1], ' ') as phrase
  from cand, (select unnest([2, 3]) as size), (select unnest([1, 2, 3]) as i) where size < depth and i + size - 1 <= depth
), kept as (
  select * from best b where not exists (select 1 from inner_ x where x.lang = b.lang and x.phrase = b.phrase and 100 * x.a >= {ABSORBED} * b.a)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept
)
select ranked.lang, rank, phrase, a, l, r, n.n, score from ranked join n on n.lang = ranked.lang where rank <= {TOP}
"""
