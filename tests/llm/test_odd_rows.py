"""Nulls in any column, empty texts, repeated rows and keys, empty tables and clashing extra columns, for the stages and operators 5 to 8."""

import pytest

import corpus_pipeline
from riskloom.llm import langid, lines, packing, simhash

LONG = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the forest today"
ROWS = [
    (1, LONG, "en", "a", 100),
    (1, LONG, "en", "a", 100),  # a row twice
    (2, LONG + " again", "en", None, None),
    (3, None, None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "en", "a", 0),
    (5, "123 456", "de", "a", 7),
    (None, "der schnelle braune fuchs springt über den faulen hund und läuft dann weg", "de", "b", 1),
    (None, None, None, None, None),
    (6, "der schnelle braune fuchs springt über den faulen hund", None, "b", 1),
    (7, "zeile\n" * 5000, "de", "b", 30000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["k", "l", "h", "row", "gone", "host", "fp", "component", "_letter0", "lang_pred", "score", "n_words", "kept", "word", "_n", "part_a", "r", "t", "line"]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([("i1", "über den faulen hund und läuft dann weg von allem anderen hier"), (None, None), ("i2", "")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_hand_on_the_columns(spark, docs, sf_dir, name, stage):
    got = stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    rows = got.collect()
    assert 0 < len(rows) <= len(ROWS) and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    want = {"language_id": None, "line_dedup": len(ROWS), "decontamination": len(ROWS)}[name] if name != "simhash_near_dedup" else None
    assert want is None or len(rows) == want
    # An empty table gives an empty table.
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_packing_stage(spark, docs, sf_dir):
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = got.collect()
    # A row without a text is its closing id alone; a row twice is packed twice.
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 and sum(r.start == 0 for r in rows if r.doc_id == 1) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_run_on_nothing(spark, docs, sf_dir):
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_operators(spark, docs):
    seen = langid.identify(docs.drop("lang_pred", "score"), None)
    assert {(r.lang_pred, r.score) for r in seen.collect()} == {("und", 0.0)} and seen.count() == len(ROWS)
    assert langid.identify(docs.limit(0), None).count() == 0
    prints = simhash.fingerprints(docs.drop("fp"))
    assert prints.count() == len(ROWS)
    held = lines.drop_boilerplate(docs, report=True)
    assert held.count() == len(ROWS) and lines.drop_boilerplate(docs.limit(0)).count() == 0
    assert packing.pack(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in held.collect() if r.doc_id in (3, 4)}
    assert by[3].text is None and by[4].text == "" and by[4].n_dropped == 0
