"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leftdeep.llm import bpe, decontaminate, jaccard, pseudonyms, quality, scoring, sharding, substrings, urlfilter, wrappers
from leftdeep.llm.session import short_batches, spread
from leftdeep.shared import stored

#: For these queries only; a real corpus gets a secret one.
PSEUDONYM_KEY = "an example key"


def _read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns)


def wrapper_main_text(spark: SparkSession, d: str) -> DataFrame:
    out = wrappers.main_text(spread(_read(spark, d, "pages", "page_id", "url", "html")))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def winnowing_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, d, "documents", "doc_id", "text"), _read(spark, d, "benchmark", "item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def feistel_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.pseudonymize(_read(spark, d, "documents", "doc_id", "text"), PSEUDONYM_KEY)


def quality_js_divergence(spark: SparkSession, d: str) -> DataFrame:
    out = quality.judge(spread(_read(spark, d, "documents", "doc_id", "text", "lang")), carried=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def lpt_sharding(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shard(_read(spark, d, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def grouped_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.link(spread(_read(spark, d, "documents", "doc_id", "text")))


def byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.decode(bpe.encode(spread(_read(spark, d, "documents", "doc_id", "text")), ranks, public_tokenizers.PATTERN), ranks)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def backoff_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(spread(_read(spark, d, "documents", "doc_id", "text")))


def repeated_substrings(spark: SparkSession, d: str) -> DataFrame:
    out = substrings.remove_repeats(spread(_read(spark, d, "documents", "doc_id", "text")))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def temporal_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "pages", "page_id", "url")
    captures = pages.withColumn("fetched", urlfilter.fetched(F.col("page_id")).cast("timestamp_ntz"))
    out = urlfilter.judge(captures, stored(urlfilter.listed(pages), "url-list"))
    return out.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"), "blocked", "kind", "value", "category", F.col("since").cast("date").alias("since"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_main_text": wrapper_main_text,
    "op2_winnowing_decontamination": winnowing_decontamination,
    "op3_feistel_pseudonyms": feistel_pseudonyms,
    "op4_quality_js_divergence": quality_js_divergence,
    "op5_lpt_sharding": lpt_sharding,
    "op6_grouped_jaccard": grouped_jaccard,
    "op7_byte_bpe": byte_bpe,
    "op8_temporal_url_filter": temporal_url_filter,
    "op9_backoff_scores": backoff_scores,
    "op10_repeated_substrings": repeated_substrings,
}
ORACLE: dict[str, str] = {
    "op2_winnowing_decontamination": decontaminate.sql(),
    "op4_quality_js_divergence": quality.sql(),
    "op8_temporal_url_filter": urlfilter.sql(),
}
