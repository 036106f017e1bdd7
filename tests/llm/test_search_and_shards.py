from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import metric_search as M
from scriptorium.llm import shards
from scriptorium.llm.common import components, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k):
    """(vec_id, vector) rows, by the contract."""
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(256 * float(x))) for x in v])
    out = []
    for q, qs in ok.items():
        if q % 5:
            continue
        best = {}
        for qv in qs:
            for c, vs in ok.items():
                if c != q:
                    for v in vs:
                        s = sum(a * b for a, b in zip(qv, v))
                        best[c] = max(best.get(c, -(1 << 60)), s)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, c, s) for r, (c, s) in enumerate(ranked)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(400)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(60)]  # one very common vector, ties by id
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (None, same), (2005, [1.0, 2.0]), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = M.top_k(df, F.col("vec_id") % 5 == 0, tree_rows=64, page=8, query_block=40)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_large_components_and_empty_vectors_score_exactly(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [r.uniform(-1, 1) * 10 ** r.randint(3, 7) for _ in range(4)]) for i in range(20)] + [(105, [1e5, 0.3, -0.2, 77777.1]), (200, []), (201, []), (202, [40_000.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = M.top_k(df, F.col("vec_id") % 5 == 0, tree_rows=16, page=4, query_block=7)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 5)


def test_trees_of_outliers_stay_shallow():
    x = np.array([[float(4**min(i, 10)) + i, 0.0] for i in range(3000)])
    most = float((x * x).sum(1).max())
    tree = M.Tree(M.build(x, [np.array([i]) for i in range(len(x))], most, 4), 2, most)
    want = sorted(((-int(v), i) for i, v in enumerate(x @ x[7]) if i != 7))[:5]
    assert tree.search(x[7], 7, 5, -np.inf) == [(-a, i) for a, i in want]


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in M.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 3, 256 * 128)]
    assert M.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_bounds_rule_pages_out():
    """On clustered vectors the stored distances spare most of the work."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(40, 16)).repeat(50, 0) + 0.02 * rng.normal(size=(2000, 16))))
    most = float((x * x).sum(1).max())
    tree = M.Tree(M.build(x, [np.array([i]) for i in range(len(x))], most, 32), 16, most)
    seen = []
    tree.pages = [(leaf, v, *rest) for leaf, v, *rest in tree.pages]

    class Counted(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    tree.pages = Counted(tree.pages)
    got = tree.search(x[3], 3, 5, -np.inf)
    s = x @ x[3]
    want = sorted(((-int(v), i) for i, v in enumerate(s) if i != 3))[:5]
    assert got == [(-a, i) for a, i in want]
    assert len(seen) < len(tree.pages) / 3


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def sample(n=300):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["a", "bb", "ccc"]) for _ in range(r.randint(0, 80))), "en", None, i) for i in range(n)]
    return rows + [(None, None, None, None, None), (1, "twice", "x", "y", 1), (1, "twice", "x", "y", 1)]


def test_compaction_keeps_every_row_and_merges(spark):
    df = spark.createDataFrame([(*r, "p") for r in sample()], DOCS + ", __path string").repartition(12)
    df = df.withColumnRenamed("__path", "path")  # a name that the manifest has too
    store = shards.Store(spark, scratch(spark, "t"), df.schema)
    for k in range(3):
        store.append(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k))
    before = store.manifest().count()
    first = multiset(store.snapshot())
    version = store.compact(target=1 << 20, fanout=4)
    after = store.manifest()
    assert version > 3 and after.count() < before
    assert multiset(store.snapshot()) == first == multiset(df)
    assert after.agg(F.sum("rows")).first()[0] == df.count()
    assert store.compact(target=1 << 20, fanout=4) == version  # nothing is left to do


def test_second_writer_conflicts_and_old_version_stays(spark):
    df = spark.createDataFrame(sample(20), DOCS)
    store = shards.Store(spark, scratch(spark, "t"), df.schema)
    store.append(df)
    with pytest.raises(shards.Conflict):
        store.commit(store.manifest(), 0)
    store.append(df)
    assert store.snapshot(1).count() == df.count() and store.snapshot().count() == 2 * df.count()


def test_older_versions_stay_and_a_writer_during_compaction_loses_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "p", "s", "a") for r in sample(60)], DOCS + ", __path string, SHARD string, arrival string").repartition(6)
    store = shards.Store(spark, scratch(spark, "t"), df.schema)
    assert store.append_each(df, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3) == 3
    old = [multiset(store.snapshot(v)) for v in (1, 2, 3)]
    late = shards.Store(spark, store.root, df.schema)
    real, calls = shards.Store._described, []

    def described(self, folder, version):
        if not calls:  # while the merged files are described, another writer commits
            calls.append(folder)
            late.append(df.limit(5))
        return real(self, folder, version)

    monkeypatch.setattr(shards.Store, "_described", described)
    with pytest.raises(shards.Conflict):
        store.compact(target=1 << 20)
    assert sum(multiset(store.snapshot()).values()) == df.count() + 5
    version = store.compact(target=1 << 20)
    assert [multiset(store.snapshot(v)) for v in (1, 2, 3)] == old
    assert sum(multiset(store.snapshot()).values()) == df.count() + 5 and store.snapshot().columns == df.columns
    shard = store.placed().columns[-1]
    assert shard == "shard_" and store.placed().where(F.col(shard)["added"] <= version).count() == df.count() + 5
    last = multiset(store.snapshot())
    store.vacuum(keep=1)  # all is younger than a day
    assert multiset(store.snapshot()) == last
    store.vacuum(keep=1, older_than=-1)
    assert multiset(store.snapshot()) == last and store.versions() == [version]


def test_tiers_and_files_against_plain_rules(spark):
    r = random.Random(4)
    for _ in range(30):
        sizes, target = [r.randrange(1, 50) for _ in range(r.randrange(1, 30))], 100
        bins = []
        for size in sorted(sizes, reverse=True):
            if not bins or sum(bins[-1]) + size > target:
                bins.append([])
            bins[-1].append(size)
        assert shards._files(sizes, target) == len(bins)
    store = shards.Store(spark, scratch(spark, "t"), spark.createDataFrame([], DOCS).schema)
    sizes = [1, shards.SMALLEST, 4 * shards.SMALLEST - 1, 4 * shards.SMALLEST, 16 * shards.SMALLEST, 70 * shards.SMALLEST]
    store.commit(spark.createDataFrame([(f"/shards/x/{n}", 1, n, 0, 1) for n in sizes], "path string, rows long, bytes long, checksum long, added long").selectExpr("path", "rows", "bytes", "cast(checksum as decimal(38,0)) checksum", "added"), 0)
    assert [x["tier"] for x in store.tiers().orderBy("bytes").collect()] == [0, 0, 0, 1, 2, 3]


def test_compaction_of_nothing(spark):
    out = shards.size_tiered_compaction(spark.createDataFrame([], DOCS), scratch(spark, "t"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "shard_id", "shard_rows", "shard_bytes", "added", "version"]


def test_sharding_query_returns_every_document(spark, sf):
    from scriptorium.llm.queries import QUERIES

    got = QUERIES["op1_sharding"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert multiset(got.select("doc_id", "n_bytes")) == multiset(docs.select("doc_id", F.octet_length("text").cast("long")))
    per = got.groupBy("shard_id").agg(F.count("*").alias("n"), F.first("shard_rows").alias("r"))
    assert per.where("n <> r").count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(200)) and got[501] == 500
