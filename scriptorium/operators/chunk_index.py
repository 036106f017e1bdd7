"""A kept index over chunks: postings with block maxima, written once, in versioned segments.

A chunk is ``(doc_id, chunk_id, text)``, as ``folds.chunks`` makes them; its ids together are
unique. ``update`` compares the chunks given with the indexed ones by a digest of their text.
Only those that are new or changed are tokenised (and embedded); they make one new segment,
and what went is noted there as dead. A segment is five Parquet tables:

* ``chunks``: segment, doc_id, chunk_id, digest, length, text, terms (with their counts);
* ``blocks``: term, block, n, max_tf, min_length, postings, each file sorted by term so that a
  filter on terms skips its pages. A block holds at most ``BLOCK`` chunks that one term weighs in
  about alike; a common term is many blocks, on as many tasks as it needs;
* ``dictionary``: term, df (a change of the document frequency, which may be negative);
* ``dead``: segment, doc_id, chunk_id of earlier chunks that no longer count;
* ``totals``: one row, the changes of the number of chunks and of their terms;

and ``vectors`` (doc_id, chunk_id, embedding, segment) where an ``embed`` is given. A version is one small file
that lists segments and is created exclusively: of two writers one fails. Older versions
stay readable; ``compact`` rewrites a version as one segment.

``search`` reads the blocks of its own terms only. The best blocks of each term give every
query a bound that its k-th chunk reaches; a block whose own maximum and the maxima of the
query's other terms stay below it together holds no chunk of the answer and is not opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import counts as C
from ..functions import text as T
from ..sources.scratch import settle
from . import retrieval as R

BLOCK = 128
#: So many distinct terms of a set of queries are filters in the scan; more meet the blocks in a join.
LITERAL_TERMS = 4096
KEY = ["segment", "doc_id", "chunk_id"]


class State(NamedTuple):
    version: int
    segments: list[str]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def state(spark: SparkSession, path: str, version: int | None = None) -> State:
    """The newest version of an index, or the one asked for; version 0 is empty."""
    folder, fs = _path(spark, f"{path}/versions")
    if version is None:
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        version = max((int(x.removesuffix(".json")) for x in found if x.endswith(".json")), default=0)
    if not version:
        return State(0, [])
    return State(version, json.loads(spark.read.text(f"{path}/versions/{version:06d}.json").first()["value"]))


def _commit(spark: SparkSession, path: str, at: State) -> int:
    file, fs = _path(spark, f"{path}/versions/{at.version:06d}.json")
    out = fs.create(file, False)  # fails where another writer made this version
    out.write(bytearray(json.dumps(at.segments).encode()))
    out.close()
    return at.version


def _table(spark: SparkSession, path: str, at: State, name: str) -> DataFrame | None:
    """One table of all segments that have it."""
    have = [f"{path}/segments/{s}/{name}" for s in at.segments]
    have = [p for p in have if (lambda q: q[1].exists(q[0]))(_path(spark, p))]
    return spark.read.parquet(*have) if have else None


def _alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(dead.select(*KEY), _same(rows, dead, KEY), "left_anti")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def live(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The chunks of a version: segment, doc_id, chunk_id, digest, length, text, terms. None of an empty index."""
    at = state(spark, path, version)
    found = _table(spark, path, at, "chunks")
    return None if found is None else _alive(found, _table(spark, path, at, "dead"))


def update(chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Make the index at ``path`` hold exactly ``chunks(doc_id, chunk_id, text)``; returns the version.
    ``embed`` gets the new chunks and returns ``doc_id, chunk_id, embedding``."""
    spark = chunks.sparkSession
    before = state(spark, path)
    given = chunks.select("doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    old, gone, fresh = live(spark, path), None, given
    if old is not None:
        keys, on = given.select("doc_id", "chunk_id", "digest"), ["doc_id", "chunk_id", "digest"]
        known = settle(old.select("segment", *on), "known")
        gone = settle(known.join(keys, _same(known, keys, on), "left_anti").select(*KEY), "gone")
        new = settle(keys.join(known, _same(keys, known, on), "left_anti"), "new")  # without texts
        fresh = given.join(new, _same(given, new, on), "left_semi")
        if gone.isEmpty() and new.isEmpty():
            return before.version
    return _write(spark, path, before, fresh, gone, old, embed, before.segments)


def compact(spark: SparkSession, path: str) -> int:
    """The live chunks of all segments as one segment; nothing is tokenised or embedded again."""
    before = state(spark, path)
    rows = live(spark, path)
    if rows is None or len(before.segments) < 2:
        return before.version
    vectors = _table(spark, path, before, "vectors")
    kept = vectors and _alive(vectors, _table(spark, path, before, "dead"))
    again = kept and (lambda fresh: kept.select("doc_id", "chunk_id", "embedding"))
    return _write(spark, path, before, rows, None, None, again, [])


def _write(spark, path: str, before: State, fresh: DataFrame, gone: DataFrame | None, old: DataFrame | None, embed, below: list[str]) -> int:
    number = before.version + 1
    name = f"{number:06d}-{uuid.uuid4().hex}"
    folder, put = f"{path}/segments/{name}", lambda df, table: df.write.option("compression", "zstd").parquet(f"{path}/segments/{name}/{table}")
    terms = F.col("terms") if "terms" in fresh.columns else C.counted(T.content_terms(F.col("text")))
    made = fresh.select(F.lit(number).cast("long").alias("segment"), "doc_id", "chunk_id", "digest", "text", terms.alias("terms"))
    length = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["tf"])
    put(made.select(*KEY, "digest", length.alias("length"), "text", "terms"), "chunks")
    rows = spark.read.parquet(f"{folder}/chunks")

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK).cast("int")), lambda i: F.slice("all", i * BLOCK + 1, F.lit(BLOCK)))
    # full blocks stay alone, what is left of a term's level comes together: fewer than a block's from each batch of chunks
    parts = _parts(rows).withColumn("part", F.when(F.size("postings") == BLOCK, F.monotonically_increasing_id()).otherwise(-1))
    blocks = parts.groupBy("term", "level", "part").agg(F.flatten(F.collect_list("postings")).alias("all")).select("term", F.explode(cut).alias("postings"))
    labelled = blocks.select(
        "term", F.lit(number).cast("long").alias("segment"), F.concat_ws(".", F.lit(number), F.monotonically_increasing_id()).alias("block"), F.size("postings").cast("long").alias("n"),
        F.array_max("postings.tf").alias("max_tf"), F.array_min("postings.length").alias("min_length"), "postings",
    )
    put(labelled.sortWithinPartitions("term"), "blocks")

    changes = [spark.read.parquet(f"{folder}/blocks").groupBy("term").agg(F.sum("n").alias("df"))]
    count = [rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms"))]
    if gone is not None:
        put(gone, "dead")
        lost = old.join(gone, _same(old, gone, KEY), "left_semi")
        changes.append(lost.select(F.inline("terms")).groupBy("term").agg((-F.count("*")).alias("df")))
        count.append(lost.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("terms")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    put(union(changes).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").sortWithinPartitions("term"), "dictionary")
    put(union(count).agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")), "totals")
    if embed:
        put(embed(rows.select("doc_id", "chunk_id", "text")).select("doc_id", "chunk_id", "embedding", F.lit(number).cast("long").alias("segment")), "vectors")
    return _commit(spark, path, State(number, [*below, name]))


#: So many postings are sorted at once.
SORTED = 1 << 20


def _parts(rows: DataFrame) -> DataFrame:
    """``term, level, postings`` of ``rows(doc_id, chunk_id, length, terms)``: the postings of some chunks that one term weighs in about alike
    and as often (so that a block's bound is near), ``BLOCK`` at most. They are sorted within a batch; no posting is a row of a shuffle."""
    mean = rows.agg(F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0))).first()[0]
    kinds, block = dict(rows.dtypes), BLOCK

    def go(batches):
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED, "right")))
                yield from cut(batch.slice(at, upto - at))
                at = upto

    def cut(batch: pa.RecordBatch):
        terms = batch.column("terms")
        flat = terms.flatten()
        if not len(flat):
            return
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False))
        coded = flat.field("term").dictionary_encode()
        word, tf = coded.indices.to_numpy(), flat.field("tf").to_numpy()
        length = batch.column("length").to_numpy()[row]
        level = (tf / (tf + R.K1 * (1 - R.B + R.B * length / mean)) * 16).astype(np.int32) * 64 + np.minimum(tf, 63)
        order = np.lexsort((level, word))
        word, level, place = word[order], level[order], np.arange(len(order))
        new = np.r_[True, (word[1:] != word[:-1]) | (level[1:] != level[:-1])]
        starts = np.flatnonzero(new | ((place - np.maximum.accumulate(np.where(new, place, 0))) % block == 0))
        ids = [batch.column(c).take(pa.array(row[order])) for c in ("doc_id", "chunk_id")]
        postings = pa.StructArray.from_arrays([*ids, pa.array(tf[order]), pa.array(length[order])], ["doc_id", "chunk_id", "tf", "length"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), postings)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word[starts])), pa.array(level[starts].astype(np.int32)), lists], ["term", "level", "postings"])

    schema = f"term string, level int, postings array<struct<doc_id:{kinds['doc_id']},chunk_id:{kinds['chunk_id']},tf:int,length:bigint>>"
    return rows.select("doc_id", "chunk_id", "length", "terms").mapInArrow(go, schema)


def _of_terms(table: DataFrame, terms: list[str] | None, asked: DataFrame) -> DataFrame:
    """The rows of asked terms: a filter that the scan has, or a join where the terms are too many for one."""
    if terms == []:
        return table.where("false")
    # one text in place of a call for each word; a term is letters and digits
    return table.where(f"term IN ({', '.join(f"'{t}'" for t in terms)})") if terms is not None else table.join(asked.select("term").distinct(), "term", "left_semi")


def bounds(spark: SparkSession, path: str, queries: DataFrame, version: int | None = None) -> tuple[DataFrame, DataFrame, list[str] | None] | None:
    """The query terms with ``idf`` and the mean length, the blocks of these terms with ``most`` (what a
    chunk of the block can score by the term), and the terms as literals if they are few."""
    at = state(spark, path, version)
    dictionary, totals, blocks = (_table(spark, path, at, t) for t in ("dictionary", "totals", "blocks"))
    if blocks is None:
        return None
    asked = settle(R.query_terms(queries), "asked")
    few = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    terms = few if len(few) <= LITERAL_TERMS else None
    df = _of_terms(dictionary, terms, asked).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    whole = totals.agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("mean")).select("n", F.coalesce(F.nullif("mean", F.lit(0.0)), F.lit(1.0)).alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = settle(asked.join(df, "term").crossJoin(F.broadcast(whole)).select("query_id", "term", "df", "n", idf.alias("idf"), "mean"), "weighed")
    heads = _of_terms(blocks, terms, asked).select("term", "block", "n", "max_tf", "min_length")
    most = _gain(F.col("max_tf"), F.col("min_length")).alias("most")
    return weighed, settle(weighed.drop("n").join(heads, "term").select("query_id", "term", "block", "n", most), "bounds"), terms


def _gain(tf: Column, length: Column) -> Column:
    return F.col("idf") * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / F.col("mean")))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, version: int | None = None) -> DataFrame | None:
    """``query_id, doc_id, chunk_id, score, rank``: the same chunks, scores and ties as a scan of all
    postings gives. None of an empty index."""
    found = bounds(spark, path, queries, version)
    if found is None:
        return None
    weighed, known, terms = found
    at = state(spark, path, version)
    blocks, dead = _of_terms(_table(spark, path, at, "blocks"), terms, weighed), _table(spark, path, at, "dead")

    whole = weighed.select("n", "mean").first() or (0, 1.0)
    asked = weighed.select("query_id", "term", F.col("term").alias("stem"))
    weights = weighed.select(F.col("term").alias("word"), F.col("term").alias("stem"), "df").distinct()

    def scored(opened: DataFrame) -> DataFrame:
        """The best chunks of each query by the postings of ``opened(term, block)``, which come together by chunk, once for all queries."""
        hits = blocks.join(opened.select("term", "block").distinct(), ["term", "block"], "left_semi").select("term", "segment", F.inline("postings"))
        held = _alive(hits, dead).groupBy("doc_id", "chunk_id", "length").agg(F.collect_list(F.struct("term", "tf")).alias("words"))
        return R.leading(held, asked, weights, *whole, k, ["doc_id", "chunk_id"]).withColumn("place", F.struct("doc_id", "chunk_id"))

    best = settle(known.groupBy("query_id", "term").agg(F.max("most").alias("top")), "best")
    # of each term the best blocks that hold k chunks together
    ahead = Window.partitionBy("query_id", "term").orderBy(F.desc("most"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = known.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("ahead") < k)
    sure = R.top(scored(first), k, tie="place")
    floor = sure.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("found")).where(F.col("found") == k).select("query_id", "floor")
    total = best.groupBy("query_id").agg(F.sum("top").alias("total"))
    reach = known.join(best.select("query_id", "term", "top"), ["query_id", "term"]).join(total, "query_id").join(floor, "query_id", "left")
    opened = settle(reach.where(F.col("most") + F.col("total") - F.col("top") >= F.coalesce("floor", F.lit(0.0)) - 1e-6).select("query_id", "term", "block"), "opened")
    return R.top(scored(opened), k, tie="place").select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def retrieve(spark: SparkSession, path: str, queries: DataFrame, asked: DataFrame | None = None, k: int = 4, version: int | None = None) -> DataFrame | None:
    """``query_id, doc_id, chunk_id, score, rank``: the first eight chunks by words fused with the first
    eight by meaning, which count 1.25; by words alone without ``asked(query_id, vector)`` or kept vectors."""
    words = search(spark, path, queries, k if asked is None else 8, version)
    at = state(spark, path, version)
    vectors = _table(spark, path, at, "vectors") if asked is not None else None
    if words is None or vectors is None:
        return words if words is None else words.where(F.col("rank") <= k)
    key = F.to_json(F.struct("doc_id", "chunk_id"), {"ignoreNullFields": "false"})
    known = _alive(vectors, _table(spark, path, at, "dead"))
    meant = R.vector_top(known.select(key.alias("vec_id"), "embedding"), asked).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    fused = R.fuse([(words.select("query_id", key.alias("doc_id"), "rank"), 1.0), (meant, 1.25)], k)
    kind = known.select("doc_id", "chunk_id").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    back = F.from_json("doc_id", kind)
    return fused.select("query_id", back["doc_id"].alias("doc_id"), back["chunk_id"].alias("chunk_id"), "score", "rank")


def answers(spark: SparkSession, path: str, ranked: DataFrame, queries: DataFrame, version: int | None = None) -> DataFrame:
    """``query_id, doc_id, chunk_id, answer``: the best sentences of each query's first chunk, and a null
    answer for queries without one."""
    first = ranked.where("rank = 1").select("query_id", "doc_id", "chunk_id")
    rows = live(spark, path, version)
    text = rows.select(F.col("doc_id").alias("d"), F.col("chunk_id").alias("c"), "text")
    here = first.join(text, first["doc_id"].eqNullSafe(text["d"]) & first["chunk_id"].eqNullSafe(text["c"])).select("query_id", "doc_id", "chunk_id", "text")
    held = settle(here, "chunk_texts")
    mine = held.select(F.col("query_id").alias("doc_id"), "text")  # one chunk a query
    said = R.best_sentences(mine, held.select("query_id", F.col("query_id").alias("doc_id")), queries).select("query_id", "answer")
    return queries.select("query_id").distinct().join(held.drop("text"), "query_id", "left").join(said, "query_id", "left")
