from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import quality, toxicity
from scriptorium.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s))
    n1, n0 = y.sum(), (1 - y).sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name, label, mod, rest, cut, least", [("op3_toxicity", "toxic", 3, 1, 0.7, 0.85), ("op10_quality_classifier", "quality", 5, 0, 0.3, 0.9)])
def test_held_out_accuracy_and_contract(spark, name, label, mod, rest, cut, least):
    got = QUERIES[name](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(rows) == 1000
    assert all(h == (zlib.crc32(str(i).encode()) % mod == rest) for i, h in zip(rows.doc_id, rows.held_out))
    assert ((rows.score >= cut) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    held = rows[rows.held_out & rows[label].notna()]
    assert auc(held[label].to_numpy(), held.score.to_numpy()) >= least


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_edges(spark, op):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (3, "x " * 20000), (3, "x " * 20000), (4, "fine words here")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = op(docs, none).collect()
    assert len(rows) == 6 and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)] + [(2, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = op(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert op(docs.where("false"), labels).count() == 0


def test_clean_keeps_columns_and_clean_rows(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words, 30)) + (" vile scum" * 3 if i % 4 == 0 else ""), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __toxicity long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(400) if i % 4]


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.unique(np.append(rng.integers(10, 5000, 40), 1 if i % 2 else 2)).astype(np.int32), i % 2) for i in range(600)]
    w, _ = toxicity.ftrl(rows, bits=13)
    assert w[1] > 0.5 and w[2] < -0.5 and (w != 0).sum() < 600


def test_features_of_words_pairs_and_skips():
    import pyarrow as pa

    a, b, c = toxicity.feature_sets(pa.array(["One two THREE four", "one, two; three? four!", None]))
    assert np.array_equal(a, b) and len(a) == 4 + 3 + 2 + 1 and len(c) == 0
