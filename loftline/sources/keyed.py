"""Tables kept in buckets of their key, so that joins and merges by it need no exchange of what is stored."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.operators.joins import one_per_key
from loftline.sources.lineage import shared_root


def default_buckets(df: DataFrame) -> int:
    """As many as shuffles have, so that a join with a shuffled side keeps to the buckets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, key: str, buckets: int | None = None, order: Sequence[Column | str] | None = None, dealt: bool = False) -> DataFrame:
    """``df`` written in buckets of ``key``, sorted by it, in the shared folder, and read back.

    With ``order``, each key keeps its first row in that order.  ``dealt`` says that rows of a
    bucket already stand together, as they do after a join or merge of keyed tables with
    as many buckets: they are then written where they are.  The table has no name in the
    catalogue; it lives as long as its files.
    """
    spark, buckets = df.sparkSession, buckets or default_buckets(df)
    rows = df if order is None else one_per_key(df, key, order)
    if not dealt:
        rows = rows.repartition(buckets, key)
    name = f"keyed_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    # The plan keeps the buckets; files of a table with a path of its own stay when the name goes.
    out.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return out
