"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_template, edit_decontam, feistel_shards, html_extract, kneser_ney
from tessera.llm import license_diagonals, media_chunks, simhash_ball, source_schedule, url_reputation
from tessera.llm.common import checkpointed, table


def op1_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null html: empty; repeated rows stay."""
    pages = html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url. Null urls have an empty host and path."""
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document and whether it is kept. Null and empty texts are not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = kneser_ney.judge_quality(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col("n").alias("n_symbols"), "perplexity", "z", "z_low", "z_high", "keep")


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id reachable over near ones. Null and empty texts: fingerprint zero."""
    docs = simhash_ball.with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    grouped = simhash_ball.with_components(checkpointed(docs.select("doc_id", "fp")))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading every formatted conversation back gives, and that of the hostile conversation -1."""
    rows = chat_template.with_hostile_conversation(table(spark, sf_dir, "conversations"))
    return chat_template.digest_pieces(chat_template.format_conversations(rows))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law `rows`. Repeated rows each have a slot."""
    docs = feistel_shards.with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sharded = feistel_shards.assign_shards(checkpointed(docs), ["doc_id", "size", "text_crc32"])
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document. Null and empty texts have none."""
    return license_diagonals.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading every document's stored payload back gives. Null texts: one unit of padding."""
    return media_chunks.media_column(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_edit_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its distance and place. Null texts hold none."""
    return edit_decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document. Null texts have none to take."""
    mixed = source_schedule.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_templates, op2_url_reputation, op3_kneser_ney, op4_simhash_ball, op5_chat_template,
        op6_feistel_shards, op7_license_diagonals, op8_media_chunks, op9_edit_decontam, op10_source_schedule,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_reputation": url_reputation.SQL, "op10_source_schedule": source_schedule.SQL}
