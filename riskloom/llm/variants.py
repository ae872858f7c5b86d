"""Spelling variant grouping by full neighbourhood generation: every distinct deletion,
replacement and insertion of a word over the observed alphabet, hash-joined to the
vocabulary. What joins is one edit away, so no distance is ever computed.

A word has some thousand neighbours, too many to exchange. One edit leaves the
first or the last half of the shorter word as it was, so words go to the groups of
their halves: a candidate whose edit lies in the last half has the group of its
first half, the very group that holds the words it can be. Each candidate is made
in one group only, and joined there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_blocks, mix64, shuffle_partitions, store

SHORTEST, LEAST, FACTOR = 5, 3, 2
#: One run in so many loses a code point (a made error that the data are given).
ERROR_IN = 97
#: Words of a group that one task holds as a hash table, at most; larger groups are cut.
MOST = 100_000
#: Rows of whole groups that are joined at a time, at least, and candidates made at a time, about.
AT_LEAST, CANDIDATES = 50_000, 1 << 20

_RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least 5 code points and 3 occurrences over all texts.

    Null texts have none, a null key counts as empty in the hash, rows that repeat count each.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(_RUN), F.lit(0))).alias("run"))
    runs = runs.select("k", F.translate("run", _UPPER, _LOWER).alias("run")).withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    at = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % ERROR_IN == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def halves(words: DataFrame) -> DataFrame:
    """words (id, word, n) in each of their four groups: side and the shorter word's length m make the group.

    In groups of its own length a word looks for replacements and insertions, in those of a
    length less for deletions; as an entry of the hash table it stands in all four.
    """
    rows = words.select("id", "word", "n", F.length("word").alias("len"), F.explode(F.array(F.lit(0), F.lit(1))).alias("less"))
    rows = rows.withColumn("m", F.col("len") - F.col("less")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    head = F.substring("word", F.lit(1), F.expr("cast(m div 2 as int)"))
    tail = F.expr("substring(word, len - (m - cast(m div 2 as int)) + 1)")
    part = F.when(F.col("side") == 0, head).otherwise(tail)
    return rows.select("id", "word", "n", "less", "side", "m", F.xxhash64("side", "m", part).alias("grp"))


def _codes(seed: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Random odd numbers for code points, powers of an odd base and its inverse modulo 2^64."""
    own = np.random.default_rng(seed)
    base = int(own.integers(1 << 62)) * 2 + 1
    powers, x = [], 1
    for _ in range(4096):
        powers.append(x)
        x = x * base % (1 << 64)
    return own.integers(1 << 63, size=256, dtype=np.uint64) * 2 + 1, np.array(powers, np.uint64), np.uint64(pow(base, -1, 1 << 64))


_CODE, _POWER, _BACK = _codes(7)


def _powers(n: int) -> np.ndarray:
    """Powers of the base for words of n code points; a longer table is made for very long runs."""
    out = _POWER
    while len(out) < n:
        out = np.r_[out, out * (out[-1] * _POWER[1:2])]
    return out[:n]


class Entries:
    """The words of groups by a hash of group and code points, with a bit map in front."""

    def __init__(self, words: list[bytes], groups: np.ndarray):
        hashes = _hashes(words) + groups
        order = np.argsort(hashes, kind="stable")
        self.hash, self.row = hashes[order], order
        bits = max(10, len(words).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.hash >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among hashes, rows of words) that share a hash; what differs but shares it comes as well."""
        at = np.flatnonzero(self.map[hashes >> self.shift])
        asked = hashes[at]
        lo, hi = np.searchsorted(self.hash, asked, "left"), np.searchsorted(self.hash, asked, "right")
        n = hi - lo
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.row[np.repeat(lo, n) + step]


def _hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    length = np.array([len(w) for w in words])
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        codes = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, n)
        out[at] = (_CODE[codes] * _powers(n)).sum(1, dtype=np.uint64)
    return out


def neighbours(words: np.ndarray, alphabet: np.ndarray, kind: str, places: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) arrays of each distinct edit of words (a matrix of code points) at the places.

    An edit that two places give alike is made at one: a deletion at the first letter of a run
    of equal ones, an insertion after the run that it lengthens.
    """
    for i in places:
        row = np.arange(len(words))
        if kind == "delete":
            row = row[words[:, i] != words[:, i - 1]] if i else row
            yield row, np.full(len(row), i), np.zeros(len(row), np.uint8)
            continue
        letter = np.tile(alphabet, len(words))
        row = np.repeat(row, len(alphabet))
        if kind == "replace":
            new = letter != words[row, i]
        else:
            new = letter != words[row, i] if i < words.shape[1] else np.ones(len(row), bool)
        yield row[new], np.full(int(new.sum()), i), letter[new]


def edited(word: bytes, kind: str, i: int, letter: int) -> bytes:
    if kind == "delete":
        return word[:i] + word[i + 1 :]
    return word[:i] + bytes([letter]) + word[i + (kind == "replace") :]


def join_group(find, words: list[bytes], alphabet: np.ndarray, kind: str, side: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, entry) pairs: candidates of words, all of one length, whose edit leaves the half of `side`
    alone. find(hashes, words of them) gives (places, entries, the entries' words)."""
    n, h = len(words[0]), m // 2
    codes = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
    power = _powers(n + 2)
    term = _CODE[codes] * power[:n]
    before = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(term, 1, dtype=np.uint64)], 1)
    whole = before[:, -1]
    last = n + (kind == "insert")
    found: list[tuple[int, int]] = []
    for row, place, letter in neighbours(codes, alphabet, kind, range(h, last) if side == 0 else range(h)):
        i = int(place[0]) if len(place) else 0
        if kind == "delete":
            hashes = before[row, i] + (whole[row] - before[row, i + 1]) * _BACK
        elif kind == "replace":
            hashes = whole[row] - term[row, i] + _CODE[letter] * power[i]
        else:
            hashes = before[row, i] + _CODE[letter] * power[i] + (whole[row] - before[row, i]) * power[1]
        at, entry, texts = find(hashes, row)
        # The join is on the word; its hash only finds it.
        found += [(w, e) for w, c, e, t in zip(row[at].tolist(), letter[at].tolist(), entry.tolist(), texts) if edited(words[w], kind, i, c) == t]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_words(words: DataFrame, alphabet: list[str]) -> DataFrame:
    """(word, n_near, form_n, form) of words (word, n) that have near words: how many, and the n
    and word of the largest, of these the first in code-point order."""
    spark = words.sparkSession
    letters = np.frombuffer("".join(alphabet).encode("latin-1"), np.uint8)
    rows = halves(words.withColumn("id", F.xxhash64("word")))
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > MOST)
    hot = sizes.select("grp", F.ceil(F.col("rows") / MOST).cast("int").alias("parts"))
    dealt = rows.join(hot, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # An entry stands in one part of a large group; its words look for theirs in every part.
    dealt = dealt.withColumn("own", F.pmod("id", "parts").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("grp", "part", "side", "m", "less", (F.col("own") == F.col("part")).alias("entry"), F.encode("word", "ISO-8859-1").alias("word"), "n")
    order = ["grp", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, _ in in_blocks(batches, order, AT_LEAST):
            word = rows_.column("word").to_pylist()
            n, m, side, less = (rows_.column(c).to_numpy() for c in ("n", "m", "side", "less"))
            entry = np.flatnonzero(rows_.column("entry").to_numpy(zero_copy_only=False))
            group = mix64(rows_.column("grp").to_numpy().view(np.uint64) + rows_.column("part").to_numpy().astype(np.uint64))
            entries = Entries([word[i] for i in entry.tolist()], group[entry])
            length = np.array([len(w) for w in word])
            # length is m or m + less, so these tell the kinds of work apart.
            kinds = (length << 2) + (side << 1) + less
            for kind_ in np.unique(kinds).tolist():
                of = np.flatnonzero(kinds == kind_)
                step = max(1, CANDIDATES // len(letters))
                for s in range(0, len(of), step):
                    at = of[s : s + step]

                    def find(hashes: np.ndarray, row: np.ndarray):
                        own = group[at[row]]
                        places, rows__ = entries.find(hashes + own)
                        target = entry[rows__]
                        same = group[target] == own[places]
                        places, target = places[same], target[same]
                        return places, target, [word[i] for i in target.tolist()]

                    for edit in ("delete",) if less[at[0]] else ("replace", "insert"):
                        w, e = join_group(find, [word[i] for i in at.tolist()], letters, edit, int(side[at[0]]), int(m[at[0]]))
                        if len(w):
                            yield _summed(word, n, at[w], e)

    found = dealt.repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(run, "word binary, n_near long, form_n long, form binary")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return summed.select(text(F.col("word")).alias("word"), "n_near", (-F.col("best.n")).alias("form_n"), text(F.col("best.form")).alias("form"))


def _summed(word: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row a word: its near words here, and the largest of them."""
    rank = {w: k for k, w in enumerate(sorted({word[i] for i in b.tolist()}))}
    order = np.lexsort(([rank[word[i]] for i in b.tolist()], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    count = np.diff(np.r_[first, len(a)])
    return pa.RecordBatch.from_arrays(
        [pa.array([word[i] for i in a[first].tolist()], pa.binary()), pa.array(count), pa.array(n[b[first]]), pa.array([word[i] for i in b[first].tolist()], pa.binary())],
        ["word", "n_near", "form_n", "form"],
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form (word, form), by pointer doubling. Counts at least
    double along a chain, so it has no more than 63 links and this loop 7 rounds."""
    at = store(forms.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = at.df.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = store(at.df.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "variant-roots")
        at.drop()
        at = moved
        if at.df.where("moved").isEmpty():
            return at.df.select("word", "root")


def variant_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word of the vocabulary.

    Two words are near if one code point inserted, deleted or replaced makes one the other.
    form is the near word of largest n (ties: the first in code-point order) if that is at
    least twice the word's; root is where forms lead. Null and empty texts have no words, an
    empty table gives no rows, rows that repeat count each; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    words = store(vocabulary(docs, key, text), "vocabulary")
    # Code points are of A-Z, a-z and U+00C0 to U+00FF: at most 90 come here.
    letters = sorted(r[0] for r in words.df.select(F.explode(F.split("word", ""))).distinct().collect() if r[0])
    if not letters:
        return words.df.select("word", *[F.lit(None).cast("string").alias(c) for c in ("form", "root")], "n", *[F.lit(None).cast("long").alias(c) for c in ("n_near", "form_n")])
    near = words.df.join(near_words(words.df, letters), "word", "left")
    large = F.col("form_n") >= FACTOR * F.col("n")
    formed = store(near.select("word", F.when(large, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("form_n")).alias("form_n")), "variant-forms")
    words.drop()
    rooted = formed.df.join(roots(formed.df), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op12_spelling_variants."""
    from .common import table

    return variant_groups(table(spark, sf_dir, "documents"))


#: crc32 bit by bit is a table of 256 entries made by its rule and one step a byte.
ORACLE = f"""
with recursive bits(i, c, k) as (
  select i, i, 0 from range(256) t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc as (select list(c order by i) as t from bits where k = 8),
runs as (
  select coalesce(doc_id::varchar, '') as k, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as raw from documents
), low as (select k, translate(raw, '{_UPPER}', '{_LOWER}') as run, count(*) as n from runs group by all),
hexed as (select *, hex(encode(k || ':' || run)) as hx from low),
hashed as (
  select run, n, xor(list_reduce([('0x' || substr(hx, (2 * i - 1)::int, 2))::bigint for i in range(1, length(hx) // 2 + 1)],
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) as h from hexed, crc
), given as (
  select n, case when h % {ERROR_IN} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed
), v as materialized (select word, sum(n)::bigint as n from given where length(word) >= {SHORTEST} group by word having sum(n) >= {LEAST}),
cut as materialized (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1))::int as i from v)
), pairs as (
  select a.word, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, v.word, v.n from cut c join v on c.rest = v.word
  union select v.word, c.word, c.n from cut c join v on c.rest = v.word
), best as (
  select word, count(*) as n_near, max(m) as m from pairs group by word
), formed as (
  select v.word, v.n, coalesce(best.n_near, 0)::bigint as n_near,
    case when best.m >= {FACTOR} * v.n then best.m end as form_n,
    case when best.m >= {FACTOR} * v.n then (select min(p.other) from pairs p where p.word = v.word and p.m = best.m) end as form
  from v left join best on best.word = v.word
), chain(word, top) as (
  select word, word from formed union all select c.word, f.form from chain c join formed f on f.word = c.top where f.form is not null
)
select f.word, f.form, c.top as root, f.n, f.n_near, f.form_n
from formed f join chain c on c.word = f.word join formed t on t.word = c.top and t.form is null
"""
