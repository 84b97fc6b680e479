"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.shared import remove, scratch_path


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (``both``): each node's larger neighbours are linked with the least of its
    neighbourhood. Small star: its smaller ones are."""
    if both:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = edges.join(least, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge; a component is named by its least
    node. ``edges``: (a, b) of longs. Every round is written to the shared folder, so no
    lineage grows; rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    path, said = scratch_path(spark, "edges"), None
    now.write.parquet(path)
    while True:
        now = spark.read.schema("a long, b long").parquet(path)
        tally = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if tuple(tally) == said:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        said, old, path = tuple(tally), path, scratch_path(spark, "edges")
        _star(_star(now, True), False).write.parquet(path)
        remove(spark, old)


