"""Sharding: small immutable shards, size-tiered compaction, versioned manifests.

A store is a folder. ``append`` writes arriving rows as they are partitioned, one small
Parquet file a task: a shard, never changed afterwards. The manifest, itself a Parquet
table, lists the live shards with rows, bytes and a checksum of their rows.

``compact`` takes the smallest tier (shards whose sizes lie within a factor of ``fanout``)
that has at least ``fanout`` shards and merges all of its runs into files of about the
target size: the read packs whole small files into partitions of that size, and each such
partition is written as one file, so nothing is shuffled and no task has more than the
target. Rows and checksums before and after must agree. It repeats until no tier is full or
the sizes say that merging makes no fewer files; shards of half the target and more are left
alone. Merging deletes nothing, so older versions stay readable and a writer that began
before a merge loses no files.

Each step is committed by renaming a pointer file to the next version's name, which fails
where that version exists: a reader sees the old shards or the new ones and never both, and
of two writers one has to start again. Files of an uncommitted step belong to no version;
``vacuum``, a step of its own, removes what no kept version lists and has been there longer
than any writer takes.

Only paths and counts of one step's shards (``MOST_SHARDS`` at most) reach the driver; the
rows are handled by DataFrame operations alone.

Nulls and ties: any column may be null, rows may repeat: rows are moved as they are. An
empty table gives a manifest without shards. Columns keep their names, whatever they are,
and order; a store takes rows of one schema. Very long texts are rows like others.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashable, remove, unused

TARGET_BYTES = 128 << 20
FANOUT = 4
SMALLEST = 1 << 16
MOST_SHARDS = 50_000
MANIFEST = "path string, rows long, bytes long, checksum decimal(38,0), added long"


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # ------------------------------------------------------------ versions

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        return jvm, path, path.getFileSystem(conf)

    def versions(self) -> list[int]:
        _, path, fs = self._fs()
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))

    def version(self) -> int:
        """The newest committed version; 0: none yet."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        pointer = json.loads(self.spark.read.text(f"{self.root}/_versions/v{version:08d}").first()[0])
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{pointer['manifest']}")

    def commit(self, shards: DataFrame, over: int) -> int:
        """Make ``shards`` the version after ``over``; ``Conflict`` where there is one already."""
        name = f"_manifests/{uuid.uuid4().hex}"
        shards.write.parquet(f"{self.root}/{name}")
        jvm, folder, fs = self._fs()
        fs.mkdirs(folder)
        draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"manifest": name, "over": over}).encode() + b"\n"))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(folder, f"v{over + 1:08d}")
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        keep = self.spark.sparkContext._gateway.new_array(rename, 1)
        keep[0] = rename.NONE
        try:  # fails where the name is taken
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), keep)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {over + 1}") from e
            raise
        return over + 1

    # ------------------------------------------------------------ shards

    def _rows(self, paths: list[str] | str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*([paths] if isinstance(paths, str) else paths))

    def _described(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files in ``folder``."""
        rows = self._rows(folder)
        each = F.xxhash64(*hashable(rows)).cast("decimal(38,0)")
        return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"), F.sum(each).cast("decimal(38,0)").alias("checksum"), F.lit(version).cast("long").alias("added")
        )

    def append(self, arrivals: DataFrame) -> int:
        """Write ``arrivals`` as new shards and commit them. Rows stay in the partitions they come in."""
        over = self.version()
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        arrivals.select(*[F.col(f"`{c}`") for c in self.schema.fieldNames()]).write.option("compression", "zstd").parquet(folder)
        return self.commit(self.manifest(over).unionByName(self._described(folder, over + 1)), over)

    def append_each(self, rows: DataFrame, arrival: Column, arrivals: int) -> int:
        """Write ``rows`` in one pass as shards of ``arrivals`` arrivals, numbered by ``arrival``
        from 0, and commit these one after the other, a version each."""
        folder, part = f"{self.root}/shards/{uuid.uuid4().hex}", unused(rows, "arrival")
        columns = [F.col(f"`{c}`") for c in self.schema.fieldNames()]
        rows.select(*columns, arrival.alias(part)).write.option("compression", "zstd").partitionBy(part).parquet(folder)
        jvm, _, fs = self._fs()
        for k in range(arrivals):
            over, own = self.version(), f"{folder}/{part}={k}"
            if fs.exists(jvm.org.apache.hadoop.fs.Path(own)):
                self.commit(self.manifest(over).unionByName(self._described(own, over + 1)), over)
        return self.version()

    def tiers(self, fanout: int = FANOUT) -> DataFrame:
        """The live shards with ``tier``: sizes within a factor of ``fanout`` share one."""
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(SMALLEST)) / SMALLEST) / F.log(F.lit(float(fanout))))
        return self.manifest().withColumn("tier", tier.cast("int"))

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge full tiers until none is left; returns the version reached."""
        spark, barren = self.spark, set()
        while True:
            over = self.version()
            small = self.tiers(fanout).where(F.col("bytes") < target // 2)
            full = [r for r in small.groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier").collect() if r["n"] >= fanout and r["tier"] not in barren]  # a row a tier
            if not full:
                return over
            tier = full[0]["tier"]
            old = small.where(F.col("tier") == tier).orderBy("bytes", "path").limit(MOST_SHARDS).drop("tier").collect()
            if _files([r["bytes"] for r in old], target) >= len(old):
                barren.add(tier)  # they fit no better together
                continue
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
            before = {k: spark.conf.get(k) for k in names}
            try:  # whole files are packed into partitions of the target size, each of which is written as one file
                spark.conf.set(names[0], str(target))
                spark.conf.set(names[1], "0")
                spark.conf.set("spark.sql.files.minPartitionNum", "1")
                self._rows([r["path"] for r in old]).write.option("compression", "zstd").parquet(folder)
            finally:
                for k, v in before.items():
                    spark.conf.set(k, v)
                spark.conf.unset("spark.sql.files.minPartitionNum")
            fresh = self._described(folder, over + 1)
            made = fresh.agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum("checksum").cast("decimal(38,0)").alias("checksum")).first()
            if (made["rows"] or 0) != sum(r["rows"] for r in old) or (made["checksum"] or 0) != sum(r["checksum"] for r in old):
                raise RuntimeError(f"merging tier {tier} changed its rows")
            if made["n"] >= len(old):  # against what the sizes say
                barren.add(tier)
                remove(spark, folder)
                continue
            gone = spark.createDataFrame([(r["path"],) for r in old], "path string")
            self.commit(self.manifest(over).join(gone, "path", "left_anti").unionByName(fresh), over)

    def vacuum(self, keep: int = 1, older_than: float = 86_400) -> list[int]:
        """Remove the folders of shards that none of the newest ``keep`` versions lists and that
        were last changed more than ``older_than`` seconds ago, and then the older versions,
        which are returned. ``older_than`` has to exceed the time that any writer or reader takes."""
        jvm, versions, fs = self._fs()
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        wanted: set[str] = set()
        for v in kept:
            runs = self.manifest(v).select(F.regexp_extract("path", "/shards/([^/]*)", 1).alias("run")).distinct()
            wanted |= {r["run"] for r in runs.toLocalIterator()}  # one name a step
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/shards")
        for v in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(versions, f"v{v:08d}"), False)
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in wanted and s.getModificationTime() < 1000 * (time.time() - older_than):
                fs.delete(s.getPath(), True)
        return old

    def _read(self, listed: DataFrame) -> tuple[DataFrame, str]:
        """The rows of the runs that hold the listed shards, and the column with their path."""
        path = unused(self.spark.createDataFrame([], self.schema), "path")
        runs = [r["run"] for r in listed.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("run")).distinct().toLocalIterator()]  # one name a step
        if not runs:
            return self.spark.createDataFrame([], self.schema).withColumn(path, F.lit(None).cast("string")), path
        return self._rows(runs).withColumn(path, F.col("_metadata.file_path")), path

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        listed = self.manifest(version)
        rows, path = self._read(listed)
        return rows.join(listed.select(F.col("path").alias(path)), path, "left_semi").drop(path)

    def placed(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each with ``shard``: a struct of the number of the shard that
        holds it, its rows and bytes and the version that added it (a further ``_`` is added to
        that name until no column has it)."""
        listed = self.manifest(version)
        rows, path = self._read(listed)
        about = F.struct(F.xxhash64("path").alias("id"), "rows", "bytes", "added").alias(unused(rows, "shard"))
        return rows.join(listed.select(F.col("path").alias(path), about), path).drop(path)


def _files(sizes: list[int], target: int) -> int:
    """Into how many files of ``target`` bytes a read packs files of these sizes."""
    files, room = 0, -1
    for size in sorted(sizes, reverse=True):
        if size > room:
            files, room = files + 1, target
        room -= size
    return files


def size_tiered_compaction(docs: DataFrame, root: str, arrivals: int = 4, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Append ``docs`` in ``arrivals`` arrivals to a new store at ``root``, compact it, and
    return, per row as it is read back from the last version: doc_id, n_bytes (of its text),
    shard_id, shard_rows, shard_bytes, added (the version that wrote the shard), version."""
    store = Store(docs.sparkSession, root, docs.schema)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), arrivals)
    version = store.compact(target, fanout)
    rows = store.placed(version)
    shard = F.col(f"`{rows.columns[-1]}`")
    return rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), shard["id"].alias("shard_id"), shard["rows"].alias("shard_rows"),
        shard["bytes"].alias("shard_bytes"), shard["added"].alias("added"), F.lit(version).cast("long").alias("version"),
    )
