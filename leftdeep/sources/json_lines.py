"""Results as JSON lines: ``{"column": {"table": value}}`` in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leftdeep.plans.naming import split_name


def _by_column(schema: T.StructType) -> dict[str, list[T.StructField]]:
    out: dict[str, list[T.StructField]] = {}
    for field in schema:
        out.setdefault(split_name(field.name)[1], []).append(field)
    return out


def to_json_column(df: DataFrame) -> Column:
    """Nulls are kept; decimals become text; timestamps are ISO 8601."""

    def value(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        return c.cast("string") if isinstance(field.dataType, T.DecimalType) else c

    groups = [
        F.struct(*[value(f).alias(split_name(f.name)[0]) for f in fields]).alias(column)
        for column, fields in _by_column(df.schema).items()
    ]
    return F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(to_json_column(df).alias("value")).write.mode(mode).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """``schema``: that of the DataFrame that was written; without it types are inferred."""
    if schema is None:
        found = spark.read.json(path)
        cols = [(c.name, t.name) for c in found.schema for t in c.dataType]
        return found.select([F.col(f"`{c}`.`{t}`").alias(f"{t}__{c}") for c, t in cols])
    text = lambda t: T.StringType() if isinstance(t, T.DecimalType) else t
    nested = T.StructType(
        [
            T.StructField(c, T.StructType([T.StructField(split_name(f.name)[0], text(f.dataType)) for f in fs]))
            for c, fs in _by_column(schema).items()
        ]
    )
    found = spark.read.schema(nested).json(path)
    return found.select(
        [
            F.col(f"`{split_name(f.name)[1]}`.`{split_name(f.name)[0]}`").cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
