"""Co-located joins: tables bucketed by their join key meet without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_bucketed(df: DataFrame, name: str, key: str | tuple[str, ...], buckets: int) -> None:
    """Write ``df`` as the catalog table ``name``; two tables with equal ``buckets`` over
    their keys are then joined where they lie (choose about 1 GB a bucket)."""
    keys = [key] if isinstance(key, str) else list(key)
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
