"""Incremental scoring as a stream: each key is handled once, results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def follow(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, handle: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Start a query that reads JSON lines as they arrive, takes one row of each new key, applies
    ``handle`` and appends the rows to ``sink`` as Parquet. What the sink already has is left out by a
    scan of its key column, so restarts append nothing twice and the query keeps no state of its own.
    Stops when the source is used up."""

    def append(batch: DataFrame, _: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(sink).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        rows = batch.dropDuplicates([key])
        handle(rows if done is None else rows.join(done, key, "left_anti")).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
