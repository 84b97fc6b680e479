"""Training text from raw documents, in stages that hand each other Parquet tables.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the
shared folder and read again as the next stage's docs. All but the last return the
columns of ``documents``:

1. quality: documents that fail the base rules or lie too far from their language go.
2. near_duplicates: of each group of linked documents the one of least doc_id stays (rows
   that repeat it: one of them). Rows without an id are linked by their texts like others;
   one of them stays only in a group without a named document. Those without words have
   no links, so all stay.
3. decontamination: documents that hold a window of a benchmark item go (also of one
   without an id).
4. pseudonyms: personal data in the text is replaced; n_chars follows the new text.
5. tokens: each text as byte-level BPE ids, with their number and the SHA-256 of the bytes
   that they decode to.

Ids are integers. Documents without a text or without words have under 20 words and go with
the first stage; run on their own, the other stages keep them. Texts of any length are
worked on whole. Of equal rows one stays (2.). An empty table passes through all stages.
Stages return the columns they were given: further ones, of any name and type, go through
all but the last unchanged, under other names while a stage works.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leftdeep.llm import bpe, decontaminate, jaccard, pseudonyms, quality
from leftdeep.llm.filters import may_hold
from leftdeep.llm.queries import PSEUDONYM_KEY
from leftdeep.llm.session import short_batches, spread
from leftdeep.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns of ``documents``.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_further_columns(stage: Stage) -> Stage:
    """``stage`` for tables with further columns, which neither it nor an operator can mistake
    for its own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"further_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@with_further_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return quality.judge(spread(docs)).where("kept").select(*docs.columns)


@with_further_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    nameless = F.col("doc_id").isNull()
    if docs.where(nameless).isEmpty():
        linked = stored(jaccard.link(docs), "linked")
        firsts = linked.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
        named, blank = docs.withColumn("_id", F.col("doc_id")), docs.limit(0)
    else:
        # Rows without an id are linked under a hash of their text, and come after named ones.
        no_words = nameless & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        named, blank = docs.where(~no_words).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), docs.where(no_words)
        linked = stored(jaccard.link(named, "_id").withColumnRenamed("doc_id", "_id"), "linked")
        hashed = named.where(nameless).select("_id", F.lit(True).alias("_hashed")).distinct()
        least = F.coalesce(F.min(F.when(F.col("_hashed").isNull(), F.col("_id"))), F.min("_id"))
        firsts = linked.join(hashed, "_id", "left").groupBy("component_id").agg(least.alias("_id")).select("_id").distinct()
    # Only rows that may go, or whose id is repeated, are moved; all others stay where they are.
    dropped = linked.select(F.col(linked.columns[0]).alias("_id")).join(firsts, "_id", "left_anti")
    repeated = named.groupBy("_id").count().where("count > 1").select("_id")
    open_ = may_hold(named, stored(dropped.union(repeated).select(F.xxhash64("_id").alias("_id")).distinct(), "open-ids"))
    is_open = F.col("_id").isNull() | open_(F.xxhash64("_id"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]  # not all types have an order
    rows = Window.partitionBy("_id").orderBy("text", *([F.to_json(F.struct(*others))] if others else []))
    moved = named.where(is_open).join(firsts, "_id", "left_semi").withColumn("_row", F.row_number().over(rows)).where("_row = 1")
    return moved.select(*docs.columns).unionByName(named.where(~is_open).select(*docs.columns)).unionByName(blank)


@with_further_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*docs.columns)


@with_further_columns
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", personal_data),
    ("tokens", tokens),
]
#: BPE can't be said in SQL; tests run the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
