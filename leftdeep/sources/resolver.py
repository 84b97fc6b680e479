"""Table names to DataFrames: a folder of Parquet tables, the catalog, or a dict."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Source:
    """``origin``: a mapping of names to DataFrames (batch or streaming), a folder
    that holds ``<name>.parquet``, or None for the session's catalog."""

    def __init__(self, spark: SparkSession, origin: Mapping[str, DataFrame] | str | None = None):
        self.spark, self.origin = spark, origin

    def table(self, name: str) -> DataFrame:
        if isinstance(self.origin, Mapping):
            if name not in self.origin:
                raise ValueError(f"unknown table {name!r}; known: {sorted(self.origin)}")
            return self.origin[name]
        try:
            if self.origin is None:
                return self.spark.table(name)
            return self.spark.read.parquet(f"{self.origin}/{name}.parquet")
        except AnalysisException as e:
            raise ValueError(f"unknown table {name!r} in {self.origin or 'the catalog'}") from e
