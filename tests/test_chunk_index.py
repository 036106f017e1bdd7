from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import words as W
from scriptorium.operators import chunk_index as X
from scriptorium.sources.scratch import shared

CHUNKS = "doc_id long, chunk_id int, text string"


def terms(text):
    return [t for t in re.findall(r"[^\W_]+", (text or "").lower()) if len(t) > 1 and t not in W.STOP_WORDS]


def scan(rows, queries, k=5):
    """All scores by plain loops."""
    own = {(d, c): Counter(terms(t)) for d, c, t in rows}
    mean = sum(sum(x.values()) for x in own.values()) / len(own) or 1.0
    df = Counter(t for x in own.values() for t in x)
    out = []
    for q, text in queries:
        scores = []
        for key, tf in own.items():
            length = sum(tf.values())
            s = sum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.4 / (tf[t] + 1.4 * (0.25 + 0.75 * length / mean)) for t in set(terms(text)) if tf[t])
            if s > 0:
                scores.append((-round(s, 9), key))
        out += [(q, *key, round(-s, 6), i + 1) for i, (s, key) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def made(seed, n=150):
    r = random.Random(seed)
    stock = [f"term{min(int(r.expovariate(0.05)), 200)}" for _ in range(4000)]
    return [(i // 4, i % 4, " ".join(r.choice(stock) for _ in range(r.choice([3, 20, 60, 180])))) for i in range(n)] + [(90, 0, None), (90, 1, ""), (91, 0, "term1 term1"), (92, 0, "term1 term1")]


ASKED = [(1, "term3 term7 term150"), (2, "term0"), (3, "nowhere else"), (4, " ".join(f"term{k}" for k in range(60))), (5, "term1"), (6, "")]


def build(spark, rows, folder, **more):
    return X.update(spark.createDataFrame(rows, CHUNKS).repartition(3), folder, **more)


def found(spark, folder, k=5, version=None):
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    return sorted(tuple(r) for r in X.search(spark, folder, queries, k, version).collect())


def equal(got, want):
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)


@pytest.mark.parametrize("block", [2, 128])
def test_search_equals_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    folder, rows = shared(spark, "x"), made(1)
    assert build(spark, rows, folder) == 1
    for k in (1, 5):
        equal(found(spark, folder, k), scan(rows, ASKED, k))


def test_updates_touch_only_what_changed(spark):
    folder, rows = shared(spark, "x"), made(2)
    build(spark, rows, folder)
    assert build(spark, rows, folder) == 1  # nothing changed: no new version
    changed = [(d, c, "term7 new words" if d == 3 else t) for d, c, t in rows if d != 5] + [(200, 0, "term3 term7 fresh")]
    assert build(spark, changed, folder) == 2
    segment = spark.read.parquet(f"{folder}/segments/{X.state(spark, folder).segments[-1]}/chunks")
    assert sorted((r["doc_id"], r["chunk_id"]) for r in segment.collect()) == [(3, 0), (3, 1), (3, 2), (3, 3), (200, 0)]
    equal(found(spark, folder), scan(changed, ASKED))
    equal(found(spark, folder, version=1), scan(rows, ASKED))  # older versions stay
    assert build(spark, rows, folder) == 3  # and back again
    equal(found(spark, folder), scan(rows, ASKED))
    assert X.compact(spark, folder) == 4 and len(X.state(spark, folder).segments) == 1
    equal(found(spark, folder), scan(rows, ASKED))


def test_a_version_is_made_once(spark):
    folder = shared(spark, "x")
    build(spark, made(3, 8), folder)
    at = X.state(spark, folder)
    with pytest.raises(Exception, match="already exists"):
        X._commit(spark, folder, at)


def test_only_asked_terms_are_read_and_blocks_skipped(spark, monkeypatch, capsys):
    monkeypatch.setattr(X, "BLOCK", 4)
    folder, rows = shared(spark, "x"), made(4, 400)
    build(spark, rows, folder)
    queries = spark.createDataFrame([(1, "term2 term170")], "query_id long, text string")
    X.search(spark, folder, queries).explain("formatted")
    said = capsys.readouterr().out
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[term1?70,?|PushedFilters: \[[^\]]*In\(term", said)
    opened = []
    monkeypatch.setattr(X, "settle", lambda df, name, own=X.settle: (lambda kept: opened.append(kept.count()) or kept)(own(df, name)) if name in ("bounds", "opened") else own(df, name))
    X.search(spark, folder, queries, 3).collect()
    assert opened[1] < opened[0]
    opened.clear()
    X.search(spark, folder, queries.withColumn("text", F.lit("term2")), 3).collect()
    assert opened[1] < opened[0]


def test_joins_where_terms_are_too_many_for_a_filter(spark, monkeypatch):
    monkeypatch.setattr(X, "LITERAL_TERMS", 3)
    folder, rows = shared(spark, "x"), made(5)
    build(spark, rows, folder)
    equal(found(spark, folder), scan(rows, ASKED))


def test_vectors_are_kept_and_fused(spark):
    folder, rows, sent = shared(spark, "x"), made(6, 40), []

    def embed(fresh):
        sent.append(fresh.count())
        return fresh.select("doc_id", "chunk_id", F.array(F.cos("doc_id"), F.sin("doc_id")).alias("embedding"))

    build(spark, rows, folder, embed=embed)
    build(spark, rows[1:] + [(300, 0, "term3")], folder, embed=embed)
    assert sent == [len(rows), 1]
    queries = spark.createDataFrame([(1, "term3 term7")], "query_id long, text string")
    vector = spark.createDataFrame([(1, [math.cos(7.0), math.sin(7.0)])], "query_id long, vector array<double>")
    fused = X.retrieve(spark, folder, queries, vector).collect()
    assert len(fused) == 4 and any(r["doc_id"] == 7 for r in fused) and [r["rank"] for r in sorted(fused, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    alone = [tuple(r) for r in X.retrieve(spark, folder, queries).collect()]
    assert alone == [tuple(r) for r in X.search(spark, folder, queries, 4).collect()]
    assert (0, 0) not in [(r["doc_id"], r["chunk_id"]) for r in X.live(spark, folder).collect()]


def test_empty_and_odd(spark):
    folder = shared(spark, "x")
    queries = spark.createDataFrame([(1, "term3"), (2, "nothing")], "query_id long, text string")
    assert X.search(spark, folder, queries) is None and X.state(spark, folder) == (0, [])
    build(spark, [(None, 0, "term3 other words here"), (1, 0, "term3")], folder)
    got = X.search(spark, folder, queries).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(1, 1, 1), (1, None, 2)] or [(r["query_id"], r["doc_id"]) for r in got] == [(1, 1), (1, None)]
    said = {r["query_id"]: r["answer"] for r in X.answers(spark, folder, X.search(spark, folder, queries), queries).collect()}
    assert said == {1: "term3", 2: None}
    build(spark, [(1, 0, "term3")], folder)
    assert [(r["doc_id"], r["rank"]) for r in X.search(spark, folder, queries).collect()] == [(1, 1)]


def test_blocks_hold_each_posting_once_and_no_more_than_their_size(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    monkeypatch.setattr(X, "SORTED", 50)
    folder, rows = shared(spark, "x"), made(7, 60) + [(i, 9, "term1 term2") for i in range(500, 540)]
    build(spark, rows, folder)
    blocks = spark.read.parquet(f"{folder}/segments/{X.state(spark, folder).segments[0]}/blocks").collect()
    assert max(r["n"] for r in blocks) == 4 and all(r["n"] == len(r["postings"]) and r["max_tf"] == max(p["tf"] for p in r["postings"]) and r["min_length"] == min(p["length"] for p in r["postings"]) for r in blocks)
    assert len({(r["term"], r["block"]) for r in blocks}) == len(blocks)
    got = sorted((r["term"], p["doc_id"], p["chunk_id"], p["tf"]) for r in blocks for p in r["postings"])
    assert got == sorted((t, d, c, n) for d, c, text in rows for t, n in Counter(terms(text)).items())
