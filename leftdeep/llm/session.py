"""What operators ask of the session and of their input's column names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker gets at once: texts are long, and a batch is held whole on both sides.
ROWS = 500


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table's scan, over all cores, where fewer of its partitions have rows (a file of
    one row group fills one of them). Only row counts of the files are read for that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("at")).distinct().count()
    return df.repartition(cores) if filled < cores else df


def unused(df: DataFrame, name: str) -> str:
    """A helper column's name that no column of ``df`` has in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns to the system what this process has freed: allocators keep it, and a Python
    worker that waits for its next task counts with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``f`` of a partition, and then give_back()."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(parts)
        give_back()

    return run
