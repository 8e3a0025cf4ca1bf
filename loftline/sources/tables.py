"""Readers and sinks for listing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loftline.sources.schema import SCHEMAS


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of a folder, read lazily."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def optional_table(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalogue table, or an empty frame of its schema where it is missing."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema or SCHEMAS[name])


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, with the columns of ``schema``; empty where it can't be read or lacks one of them."""
    try:
        found = spark.read.parquet(path)
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    except AnalysisException:
        return spark.createDataFrame([], schema)


def sheet(df: DataFrame, key: str) -> DataFrame:
    """Rows of an exported sheet that have their key column: drops titles and footnotes."""
    return df.where(F.col(f"`{key}`").isNotNull())


def positional(df: DataFrame, names: dict[int, str], skip: int = 0) -> DataFrame:
    """Rename columns by position, drop rows with nulls in any column, then the first ``skip`` rows in file order."""
    renamed = df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns)])
    rows = renamed.withColumn("_at", F.monotonically_increasing_id()).na.drop(subset=renamed.columns)
    if skip:
        # Row numbers grow with the file's order; only the first few are looked at.
        last = rows.select("_at").orderBy("_at").limit(skip).agg(F.max("_at").alias("_last"))
        rows = rows.crossJoin(F.broadcast(last)).where(F.col("_at") > F.col("_last"))
    return rows.select(*names.values())


def queue(df: DataFrame) -> DataFrame:
    """Work queue, oldest first."""
    return df.orderBy(F.asc_nulls_last("added_at"), "zillow_url").select("zillow_url")


def replace_table(df: DataFrame, name: str, stamp: str | None = None) -> None:
    """Full replacement of a catalogue table; ``stamp`` names a column for the time of writing."""
    (df.withColumn(stamp, F.current_timestamp()) if stamp else df).write.mode("overwrite").saveAsTable(name)


def append_rows(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def _finite(c: str) -> Column:
    return F.when(F.isnan(F.col(f"`{c}`")), F.lit(None)).otherwise(F.col(f"`{c}`"))


def without_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN to null in all floating columns, or only in those named."""
    kinds = dict(df.dtypes)
    pick = [c for c in (columns or df.columns) if kinds.get(c) in ("float", "double")]
    return df.withColumns({c: _finite(c) for c in pick})


def records(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object a row, nulls written out."""
    clean = without_nan(df, columns)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]), {"ignoreNullFields": "false"}).alias("record"))


def save_checkpoint(spark: SparkSession, path: str, page: int, index: int) -> None:
    """Where a crawl stands, as one row of JSON."""
    spark.range(1).select(F.lit(page).alias("page"), F.lit(index).alias("index"), F.current_timestamp().alias("saved_at")).coalesce(1).write.mode("overwrite").json(path)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[int, int] | None:
    try:
        row = spark.read.schema("page int, index int, saved_at timestamp").json(path).first()
    except Exception as error:  # a folder that isn't there
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return (row["page"], row["index"]) if row else None


def clear_checkpoint(spark: SparkSession, path: str) -> None:
    """Forget where a crawl stands: the next one begins anew."""
    spark.createDataFrame([], "page int, index int, saved_at timestamp").coalesce(1).write.mode("overwrite").json(path)


def resumed(links: DataFrame, page: int, index: int) -> DataFrame:
    """What is left of ordered links (page, pos): later pages, and from ``index`` on this page."""
    return links.where((F.col("page") > page) | (F.col("page") == page) & (F.col("pos") >= index))


def feature_rows(df: DataFrame, column: str = "arguments") -> DataFrame:
    """Structured feature records (JSON) to typed rows with their key.

    Fields are taken one by one: an entry of another type is null by itself, and unknown
    fields and their order don't matter.  A record that is no JSON has nulls throughout.
    """
    from loftline.sources.schema import FEATURE_KINDS, struct_of

    held = df.select("zpid", F.try_parse_json(F.col(column)).alias("_v"))
    return held.select("zpid", *[F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in struct_of(FEATURE_KINDS)])
