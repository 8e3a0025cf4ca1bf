"""Tables that stand between the steps of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by sessions in a single process that name no shared folder, as in tests.
LOCAL_ROOT = "file:///tmp/checkpoints/loftline"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = LOCAL_ROOT
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once: written as Parquet and read back, which cuts its lineage."""
    path = f"{shared_root(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
