from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, secrets
from scriptorium.llm.queries import ORACLES, QUERIES


def test_stages_one_by_one(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs = read("documents")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, tables[-1], sf)
        assert out.columns == docs.columns
        tables.append(out.cache())
    ids = [[r["doc_id"] for r in t.select("doc_id").collect()] for t in tables]
    toxic = {r["doc_id"] for r in QUERIES["op3_toxicity"](spark, sf).where("predicted = 1").collect()}
    assert sorted(ids[1]) == sorted(set(ids[0]) - toxic)
    groups = {}
    from .test_text_ops import joined

    for i, _, c in joined([(r["doc_id"], r["text"]) for r in tables[1].collect()]):
        groups.setdefault(c, []).append(i)
    assert sorted(ids[2]) == sorted(groups)
    leaked = {r["doc_id"] for r in decontaminate.leaks(tables[2], read("benchmark")).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaked)
    assert sorted(ids[4]) == sorted(ids[3])
    assert secrets.secret_scan(tables[4]).where("n_assign + n_access + n_hex > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[4], sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(ids[4])
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_run_returns_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_near_copies_go_from_four_fifths_of_five_word_runs_on(spark, sf):
    import itertools
    import random

    from .test_text_ops import docs_of, near_copies, shingles, words

    r = random.Random(5)
    texts, base = near_copies(3), words(r, 200)
    edited = list(base)
    for k in range(4):
        edited[20 + 40 * k] = f"edit{k}"
    copies = [base, base + words(r, 45), base[:165], edited, base + words(r, 60), base[:125]]
    texts += [" ".join(c) for c in copies]
    sets = [shingles(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = [i for i in range(len(texts)) if find(i) == i]
    first = len(texts) - len(copies)
    assert [i - first for i in want if i >= first] == [0, 4, 5]
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs_of(spark, texts), sf)
    assert sorted(x["doc_id"] for x in kept.collect()) == want
