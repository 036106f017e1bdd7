"""Reading the driver tables and splitting documents into pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it is smaller than a scan's partition a core: such a file
    may hold all rows in one row group, which one task reads. Larger tables stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * (128 << 20) else df


def pages(docs: DataFrame) -> DataFrame:
    """``doc_id, page, text``: a form feed starts a page; blank pages keep their number."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "text"))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of every line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
