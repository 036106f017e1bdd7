"""Shared small helpers: reading tables, durable scratch tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the shared folder's owner clears it
            return


atexit.register(_sweep)


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough for very long texts; set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost
    executor costs only a new read. The files go when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # shuffle files of this write go when it has ended
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch = path
    return kept


def discard(*kept: DataFrame) -> None:
    """The files of settled tables that nothing reads any more go at once."""
    for df in kept:
        remove(df.sparkSession, df.scratch)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df``, of any types and names, as a hash takes them, and which are null."""
    columns = [(F.col(f"`{c.replace('`', '``')}`"), t) for c, t in df.dtypes]
    whole = [F.to_json(F.struct(c.alias("x"))) if "map<" in t or "variant" in t else c for c, t in columns]
    return whole + [c.isNull() for c, _ in columns]  # the hash passes nulls over


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row's columns as text: equal rows have equal ones."""
    whole = hashable(df)
    return F.concat(F.hex(F.xxhash64(F.lit(1), *whole)), F.lit("."), F.hex(F.xxhash64(F.lit(2), *whole)))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs.

    Returns ``(node, root)``, root being the least node of the component. Every round
    hooks each node to the least label around it and then jumps pointers, so rounds
    grow with the logarithm of a component's diameter. Only a count reaches the driver.
    """
    both = settle(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    for _ in range(max_rounds):
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        # the old root learns of the lower label too, else long chains move one step a round
        told = hooked.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("via_root"))
        # written before the jump, whose key may be the label of very many nodes: such a join can be split
        step = settle(hooked.join(told, "node", "left").select("node", "root", F.least("low", F.coalesce("via_root", "low")).alias("next")), "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        new = settle(
            step.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("beyond", "next")).alias("next")),
            "labels",
        )
        moved = new.where("next <> root").limit(1).count()
        labels = new.select("node", F.col("next").alias("root"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
