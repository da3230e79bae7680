"""Incremental ingest of landed API responses into a publication store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from labelloom.sources import key_index


def ingest_new(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    key: str,
    parse: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Append parsed responses whose key is not stored yet; runs over what has landed and stops.

    Each micro-batch opens only those files of the store that may hold one of its keys (`key_index`). A
    replayed batch finds its own rows in the store and adds nothing, so an interrupted run can simply be
    started again.
    """
    lines = spark.readStream.text(landing).withColumnRenamed("value", "payload")

    def add(batch: DataFrame, _batch_id: int) -> None:
        key_index.append_new(parse(batch), store, key)

    return (
        lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
