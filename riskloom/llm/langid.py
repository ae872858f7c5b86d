"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter's largest response is kept, and a softmax layer names the
language. A text is covered by overlapping windows; its probabilities are the
means of theirs, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 20
EMBEDDING = 8
OVERLAP = max(WIDTHS) - 1
#: The bound of what is trained on: rows of a language, rows in all (so of each language an even part of them, one at
#: least, and of the most frequent languages alone where there are more than that), windows of a row.
ROWS_PER_LANGUAGE, ROWS, WINDOWS_PER_ROW = 500, 20_000, 6
STEPS, BATCH = 700, 96
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def _columns(self, x: np.ndarray, width: int) -> np.ndarray:
        """Embedded bytes of every place of a filter: (windows, places, width * embedding)."""
        e = self.embed[x]
        return np.concatenate([e[:, i : x.shape[1] - width + 1 + i] for i in range(width)], axis=2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window, at least 0, and its place."""
        values, places = [], []
        for w, b in zip(self.filters, self.bias):
            r = self._columns(x, len(w) // EMBEDDING) @ w
            at = r.argmax(1)
            values.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + b, 0))
            places.append(at)
        return np.concatenate(values, 1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(x)[0] @ self.out + self.shift)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: list[bytes], labels: list[str], seed: int = 0) -> Network:
    """Adam on the cross-entropy of random crops; languages count alike however many rows they have."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    size = len(WIDTHS) * FILTERS
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, (1 / size) ** 0.5, (size, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    weights = [net.embed, *net.filters, *net.bias, net.out, net.shift]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_language = [np.flatnonzero(y == k) for k in range(len(languages))]
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(by_language[k]) for k in rng.integers(0, len(languages), BATCH)])
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for row, i in enumerate(pick):
            text = windows[i]
            n = min(len(text), int(rng.integers(12, WINDOW + 1)))
            start = int(rng.integers(0, len(text) - n + 1))
            x[row, :n] = np.frombuffer(text, np.uint8)[start : start + n]
        grads = _gradients(net, x, y[pick])
        rate = 0.01 * (1 - (step - 1) / STEPS) + 0.0005
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        net.embed[0] = 0
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    pooled, places = net.pooled(x)
    d = softmax(pooled @ net.out + net.shift)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    back = (d @ net.out.T) * (pooled > 0)
    g_embed = np.zeros_like(net.embed)
    g_filters, g_bias = [], []
    rows = np.arange(len(x))[:, None, None]
    for k, (w, at) in enumerate(zip(net.filters, places)):
        width = len(w) // EMBEDDING
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        seen = x[rows, at[:, :, None] + np.arange(width)]  # window, filter, byte
        e = net.embed[seen].reshape(len(x), FILTERS, -1)
        g_filters.append(np.einsum("nf,nfi->if", own, e, optimize=True))
        g_bias.append(own.sum(0))
        to = own[:, :, None] * w.T[None]
        np.add.at(g_embed, seen.ravel(), to.reshape(-1, EMBEDDING))
    return [g_embed, *g_filters, *g_bias, pooled.T @ d, d.sum(0)]


def cover(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some texts: (windows, first window of each text, bytes in each window)."""
    size = np.array([len(t) for t in own], np.int64)
    n = np.maximum(1, -(-(size - OVERLAP) // (WINDOW - OVERLAP)))
    first = np.r_[0, np.cumsum(n)[:-1]]
    text = np.repeat(np.arange(len(own)), n)
    start = (np.arange(n.sum()) - first[text]) * (WINDOW - OVERLAP)
    inside = np.minimum(size[text] - start, WINDOW)
    joined = np.frombuffer(b"".join(own) + bytes(WINDOW), np.uint8)
    at = np.r_[0, np.cumsum(size)[:-1]][text] + start
    x = joined[at[:, None] + np.arange(WINDOW)]
    x[np.arange(WINDOW) >= inside[:, None]] = 0
    return x, first, inside


def predict(net: Network, own: list[bytes], step: int = 64) -> np.ndarray:
    """Probabilities (texts, languages). Empty texts have no meaning; the caller names them unknown."""
    out = np.empty((len(own), len(net.languages)))
    i = 0
    while i < len(own):
        j, n = i, 0
        while j < len(own) and (j == i or n + len(own[j]) < 1 << 18):
            n += len(own[j])
            j += 1
        x, first, weight = cover(own[i:j])
        p = np.concatenate([net.probabilities(x[k : k + step]) for k in range(0, len(x), step)])
        weight = np.maximum(weight, 1)[:, None]
        out[i:j] = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
        i = j
    return out


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[bytes], list[str]]:
    """A bounded sample of the labelled rows that aren't held out: of each language a
    share by hash, of that the first rows by hash, and of each row some windows
    spread over its text."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(lang).alias("l"))
    counts = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(ROWS).collect()
    each = max(1, min(ROWS_PER_LANGUAGE, ROWS // max(1, len(counts))))
    # A share by hash that leaves about twice the rows wanted, and a score more, so that the ranking below stays small whatever the table's size.
    share = docs.sparkSession.createDataFrame([(r.l, (2.0 * each + (0 if each == ROWS_PER_LANGUAGE else 20)) / r.n) for r in counts], "l string, share double")
    some = labelled.withColumn("l", F.col("l").cast("string")).join(F.broadcast(share), "l").where(F.expr("pmod(xxhash64(k, 5), 1000000007)") < F.col("share") * 1000000007)
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k", F.lit(5)), "k"))
    chosen = some.withColumn("r", rank).where(F.col("r") <= each).select("k").distinct()
    rows = docs.where(~held_out(key)).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    few = rows.join(F.broadcast(chosen), "k").where(F.col("l").isNotNull() & has_letter("t"))  # at most ROWS keys
    # A key that repeats stands for one row, so that rows are bounded, too.
    few = few.groupBy("k").agg(F.min(F.struct("l", F.xxhash64("t"), "t")).alias("r")).select("k", "r.l", "r.t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, lang_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b, "t")):
                n = max(1, min(WINDOWS_PER_ROW, len(t) // WINDOW))
                for i in range(n):
                    at = (len(t) - WINDOW) * i // max(1, n - 1) if n > 1 else 0
                    out.append((str(k), i, lang_, t[max(0, at) : max(0, at) + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.binary()))] if out else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.string(), pa.binary())], ["k", "i", "l", "w"])

    found = sorted((r.l, r.k, r.i, bytes(r.w)) for r in few.mapInArrow(cut, "k string, i int, l string, w binary").collect())
    return [r[3] for r in found], [r[0] for r in found]


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1). A null text or one without a letter is `und` with score 0,
    and so is every text if there is no network (nothing labelled to learn from)."""

    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            own = texts(batch, text)
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            pred, score = np.full(len(own), UNKNOWN, object), np.zeros(len(own))
            some = np.flatnonzero(letter)
            if net is not None and len(some):
                p = predict(net, [own[i] for i in some])
                best = p.argmax(1)
                pred[some] = np.array(net.languages, object)[best]
                score[some] = np.clip(p[np.arange(len(some)), best], 0, 1)
            return [pa.array(pred, pa.string()), pa.array(score)]

        return fn

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    keep = docs.columns if keep is None else keep
    names = set(docs.columns)
    free = next(n for i in range(len(names) + 1) if (n := f"_letter{i}") not in names)
    return append_columns(docs.select("*", has_letter(text).alias(free)), make, fields, keep)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    windows, labels = training_windows(docs, key, text, lang)
    return train(windows, labels) if windows else None


#: Below this score a language isn't taken as known, or below this multiple of an even share where many languages were learnt.
LEAST_SCORE, EVEN_SHARES = 0.3, 2.0


def least_score(net: Network) -> float:
    return min(LEAST_SCORE, EVEN_SHARES / len(net.languages))


def keep_identified(docs: DataFrame, net: Network | None, text: str = "text", least: float | None = None) -> DataFrame:
    """Rows of docs whose language is named with at least that score; columns unchanged.

    Null texts and texts without a letter go, and without a network (nothing to learn from) every text.
    Repeated rows and keys are judged one by one; an empty table gives no rows.
    """
    if least is None:
        least = least_score(net) if net is not None else LEAST_SCORE
    cols = docs.columns
    inner = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(cols)])
    seen = identify(inner, net, f"in_{cols.index(text)}")
    return seen.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(cols)])


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op6_language_id."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    seen = identify(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"])
    return seen.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
