"""Token counts of the parts of a text by offset-mapped attribution.

A whole text is encoded once; the byte spans of its tokens follow from the sizes
of their ids. Sections are byte spans too. Both lists are sorted, so the interval
join is one pass; a token across a boundary goes to the section that holds most
of its bytes, at a tie to the earlier one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import append_columns, texts


def line_sections(text: bytes) -> np.ndarray:
    """First byte of each line, and the end; a line keeps its line feed. No lines in an empty text."""
    if not text:
        return np.zeros(1, np.int64)
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.r_[0, ends, len(text)] if not len(ends) or ends[-1] != len(text) else np.r_[0, ends]


_ENDS = re.compile(rb"[.!?]+[ \t]+|\n")


def sentence_sections(text: bytes) -> np.ndarray:
    """First byte of each sentence, and the end. A sentence ends behind full stops, question or exclamation
    marks and the blanks after them, or behind a line feed: the blank that a token begins with stands in the
    sentence before, so most first tokens of a sentence cross its boundary."""
    if not text:
        return np.zeros(1, np.int64)
    ends = np.fromiter((m.end() for m in _ENDS.finditer(text)), np.int64)
    return np.r_[0, ends, len(text)] if not len(ends) or ends[-1] != len(text) else np.r_[0, ends]


#: What a text can be cut into: adjacent byte spans that hold all of it.
SECTIONS = {"line": line_sections, "sentence": sentence_sections}


def token_spans(enc: bpe.Encoder, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each token of a text."""
    s = text.decode()
    ids = enc.encode(s)
    if enc.size is not None:
        ends = np.cumsum(enc.size[ids]) if len(ids) else np.zeros(0, np.int64)
        return np.r_[0, ends[:-1]] if len(ids) else ends, ends
    at = np.r_[0, np.cumsum([len(c.encode()) for c in s])]
    spans = np.array(enc.tokenizer.encode(s, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    return at[spans[:, 0]], at[spans[:, 1]]


def allocate(first: np.ndarray, end: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, int]:
    """(section of each token, tokens that cross a boundary).

    edges: ascending starts of adjacent sections and the end of the last. A token
    of no bytes goes to the section at its place.
    """
    n = len(edges) - 1
    a = np.clip(np.searchsorted(edges, first, "right") - 1, 0, n - 1)
    b = np.clip(np.searchsorted(edges, end, "left") - 1, a, n - 1)
    out, crossing = a.copy(), np.flatnonzero(a != b)
    # Over one boundary the larger part decides, at a tie the earlier.
    two = crossing[b[crossing] == a[crossing] + 1]
    cut = edges[b[two]]
    out[two] = np.where(end[two] - cut > cut - first[two], b[two], a[two])
    for t in crossing[b[crossing] > a[crossing] + 1]:
        inside = np.arange(a[t], b[t] + 1)
        out[t] = inside[np.argmax(np.minimum(edges[inside + 1], end[t]) - np.maximum(edges[inside], first[t]))]
    return out, len(crossing)


def count_sections(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None, by: str = "line") -> DataFrame:
    """docs with n_tokens, n_crossing (tokens across a boundary) and sections: for each line
    or sentence start and end (bytes) and tokens, which add up to n_tokens. Null and empty
    texts have no sections and no tokens; rows that repeat are counted each, an empty table
    gives no rows; input columns named like a result are replaced."""
    path = path or bpe.default_path()
    cut = SECTIONS[by]
    section = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "tokens")])

    def make():
        enc = bpe.encoder(path)

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            total, crossing, sizes, flat = [], [], [], []
            for t in texts(batch, text):
                edges = cut(t)
                first, end = token_spans(enc, t)
                where, crossed = allocate(first, end, edges) if len(edges) > 1 else (first, 0)
                total.append(len(first))
                crossing.append(crossed)
                sizes.append(len(edges) - 1)
                flat.append(np.stack([edges[:-1], edges[1:], np.bincount(where, minlength=len(edges) - 1) if len(edges) > 1 else np.empty(0, np.int64)]))
            values = np.concatenate(flat, 1).astype(np.int64)
            struct = pa.StructArray.from_arrays([pa.array(v) for v in values], ["start", "end", "tokens"])
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            return [pa.array(total, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(offsets, struct)]

        return fn

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("sections", T.ArrayType(section))]
    return append_columns(docs, make, fields, keep)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op3_token_counts: tokens of every sentence of every document."""
    from .common import table

    seen = count_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], by="sentence")
    return seen.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), F.col("sections.tokens").alias("section_tokens"))
