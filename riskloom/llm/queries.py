"""Queries of the training-data operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontam, embeddings, extract, langid, lines, nearest, packing, repeats, simhash, token_counts, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat.digest,
        "op2_embedding_near_dedup": embeddings.digest,
        "op3_token_counts": token_counts.digest,
        "op4_suffix_array_dedup": repeats.digest,
        "op5_simhash_near_dedup": simhash.digest,
        "op6_language_id": langid.digest,
        "op7_packing": packing.digest,
        "op8_line_dedup": lines.digest,
        "op9_html_extraction": extract.digest,
        "op10_decontamination": decontam.digest,
        "op11_phrase_collocations": collocations.digest,
        "op12_spelling_variants": variants.digest,
        "op13_nearest_neighbours": nearest.digest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op2_embedding_near_dedup": embeddings.ORACLE, "op8_line_dedup": lines.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_phrase_collocations": collocations.ORACLE, "op12_spelling_variants": variants.ORACLE}
