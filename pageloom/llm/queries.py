"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import garbled, lookalike, mixing, reading, residue, styletree, tokens
from pageloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf, "blocks"), table(spark, sf, "links"))


def p1_texts(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonical_text(table(spark, sf, "links"), "text", ["page_id", "pos"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf, "fetch_results")).select("page_id")


def p2_usable(spark: SparkSession, sf: str) -> DataFrame:
    return residue.usable_pages(table(spark, sf, "fetch_results")).select("page_id", "url", "status")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.examine_pages(table(spark, sf, "fetch_results"), with_html=False).select("page_id")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.examine_pages(table(spark, sf, "fetch_results"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return styletree.noise_blocks(table(spark, sf, "fetch_results"), table(spark, sf, "blocks"))


def p5_body(spark: SparkSession, sf: str) -> DataFrame:
    return styletree.body_blocks(table(spark, sf, "fetch_results"), table(spark, sf, "blocks"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf, "documents"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares_of(p7_mix(spark, sf), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_levels(spark, sf).where("reading_level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts, "p2_found": p2_found, "p2_usable": p2_usable, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_body": p5_body, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_levels": p8_levels}

_CANON = lookalike.canonical_sql("(" + lookalike.rare_sql("text") + ")")
ORACLE = {
    "p1_texts": f"SELECT page_id, pos, {_CANON} AS canon FROM links",
    "p1_found": f"""WITH b AS (SELECT page_id, block_id, text, {_CANON} AS canon FROM blocks WHERE text <> ''),
 k AS (SELECT page_id, pos, text, {_CANON} AS canon FROM links WHERE text <> '')
 SELECT DISTINCT b.page_id, b.block_id, k.pos FROM b JOIN k ON b.page_id = k.page_id AND b.canon = k.canon WHERE b.text <> k.text AND b.canon <> ''""",
}
