"""Last-write-wins merge of a change stream (an addition for scale, not a listing feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loftline.operators.merge import last_writes


def merged_log(spark: SparkSession, path: str, key: str, stamps: Sequence[str], value: str) -> DataFrame:
    """The table that a folder of change batches stands for."""
    return last_writes(spark.read.parquet(path), key, stamps).where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")


def follow_changes(changes: DataFrame, path: str, checkpoint: str, key: str, stamps: Sequence[str]) -> StreamingQuery:
    """Append each micro-batch's last writes under ``path``; a batch that is repeated overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        last_writes(batch, key, stamps).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and type, with a watermark for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
