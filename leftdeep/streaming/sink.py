"""A chain over streaming inputs, written as the same JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leftdeep.sources.json_lines import to_json_column


def stream_json(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing a streaming chain (``JoinPlan.to_df()`` over a mapping that holds a
    streaming DataFrame). ``checkpoint``: a folder that all machines share."""
    writer = df.select(to_json_column(df).alias("value")).writeStream.format("text").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
