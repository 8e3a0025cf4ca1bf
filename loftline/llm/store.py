"""Written intermediate tables in the folder that the whole cluster shares, and tasks that give memory back."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only by sessions in a single process that name no shared folder, as in tests.
LOCAL_ROOT = "file:///tmp/checkpoints/loftline"
_shipped: set[str] = set()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def attach(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import loftline

    root = os.path.dirname(os.path.abspath(loftline.__file__))
    target = os.path.join(tempfile.mkdtemp(), "loftline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own if one process runs everything."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = LOCAL_ROOT
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the stage at hand.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Give back the space of tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            # An empty table takes its place: Spark's writer deletes the files, wherever they are.
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def lean(task: Callable) -> Callable:
    """``task`` as a function of batches that returns freed memory to the system as it goes and when it ends.

    Python workers are used again; what they keep for themselves, the next stage's can't have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, batch in enumerate(task(batches)):
                yield batch
                if k % 16 == 15:
                    give_back()
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
