"""The stateless operators over streams: string feeds in, typed rows out.

Normalisers, filters and column functions hold no state, so they run on a streaming DataFrame as
they are. follow() appends the rows of arriving files to a Parquet table, each file once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, normalise: Callable[[DataFrame], DataFrame], into: str, checkpoint: str) -> StreamingQuery:
    """schema must hold row_id; the query ends once all files there have been read."""
    rows = normalise(spark.readStream.schema(schema).parquet(folder))
    return rows.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
