"""What the token files' metadata hold, and that readers use it."""

import glob

import numpy as np
from pyarrow import orc
from pyspark.sql import functions as F

from loftline.llm import tokenbin


def rows_read(df):
    """Rows that the scan of ``df`` hands on, by Spark's own count."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.startswith("Scan orc"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.length()):
            walk(children.apply(k))

    walk(plan)
    assert found
    return sum(found)


def test_stripes_indexes_and_bloom_filters(spark, tmp_path):
    # Even ids only, in one file of several stripes.
    docs = spark.range(0, 12_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(6)]).alias("text")).coalesce(1)
    path = f"{tmp_path}/ids"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokenbin.write_token_ids(docs, path, stripe_bytes=64 << 10, row_stride=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = sorted(glob.glob(f"{path}/*.orc"))
    held = [orc.ORCFile(f) for f in files]
    assert sum(h.nrows for h in held) == 6000 and sum(h.nstripes for h in held) > 1
    assert all(h.row_index_stride == 1000 and h.compression == "ZSTD" for h in held)
    # Stripes can be read apart, and together they are the file.
    parts = [np.concatenate([held[0].read_stripe(k, ["doc_id"])["doc_id"].to_numpy() for k in range(held[0].nstripes)])]
    assert parts[0].tolist() == sorted(parts[0].tolist()) and len(parts[0]) == held[0].nrows
    # An id that is there is looked up in its row group; one that isn't, though its neighbours are, is told by the filters.
    table = tokenbin.read_token_ids(spark, path)
    assert table.where("doc_id = 5000").count() == 1
    assert 0 < rows_read(table.where("doc_id = 5000").select("shard")) <= 2000
    absent = [rows_read(table.where(f"doc_id = {k}").select("shard")) for k in (2001, 4003, 5555, 7777)]
    assert sum(absent) < 1000
    # Filters are named in the file's footer by their encoding.
    raw = open(files[0], "rb").read()
    assert b"doc_id" in raw


def test_stripes_are_read_by_several_tasks(spark, tmp_path):
    docs = spark.range(0, 16_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(4)]).alias("text")).coalesce(1)
    path = f"{tmp_path}/ids"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        tokenbin.write_token_ids(docs, path, stripe_bytes=64 << 10, row_stride=1000)
        table = tokenbin.read_token_ids(spark, path)
        tasks = [r["n"] for r in table.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(glob.glob(f"{path}/*.orc")) == 1 and len(tasks) > 1 and sum(tasks) == 16_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
