"""From raw documents to packed training sequences.

Each stage takes all that the one before kept, decides on it, and hands on the
columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, langid, lines, overlap, packing
from riskloom.llm.common import store, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network names; learnt from the labelled ones.

    Null texts and texts without a letter go; if no document is labelled, all others stay.
    Rows that repeat are judged alike, one by one.
    """
    net = langid.learn(docs)
    return docs.where(langid.has_letter("text")) if net is None else langid.keep_identified(docs, net)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that too many documents of their source have; n_chars follows the text.

    Null texts stay null, a null source is one of its own, rows that repeat are pages each, an empty table gives none.
    """
    return lines.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest key.

    Texts of fewer than five words are one shingle; null and wordless texts are no copies of anything and stay.
    Of rows that repeat one stays; an empty table gives none.
    """
    return overlap.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts have none and stay;
    an empty benchmark keeps all."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the curve. A null text is its closing id alone; rows that repeat are packed each."""
    packed = packing.pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A network and a tokenizer decide; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES[:-1]:
        after = store(stage(spark, docs, sf_dir), f"stage-{name}")
        if written:
            written.drop()
        docs, written = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
