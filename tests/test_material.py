from __future__ import annotations

import math
import random
import time
from collections import defaultdict

from scriptorium.operators import retrieval as R


def plain(terms, order, most, alike):
    """Every candidate against every picked one."""
    df = defaultdict(int)
    for ts in terms:
        for t in set(ts):
            df[t] += 1
    vectors = []
    for ts in terms:
        v = defaultdict(float)
        for t in ts:
            v[t] += math.log(1 + len(terms) / df[t])
        vectors.append(v)
    cosine = lambda a, b: sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items()) / (math.sqrt(sum(w * w for w in vectors[a].values()) * sum(w * w for w in vectors[b].values())) or 1.0)
    kept = []
    for i in order:
        if len(kept) < most and all(cosine(j, i) < alike for j in kept):
            kept.append(i)
    return kept


def test_picks_equal_the_plain_greedy_rule():
    r = random.Random(1)
    for alike in (0.3, 0.6, 0.9):
        terms = [[f"t{int(r.expovariate(0.1))}" for _ in range(r.randint(4, 12))] for _ in range(150)] + [["t1", "t2", "t3", "t4"]] * 5
        order = r.sample(range(len(terms)), len(terms))
        for most in (3, 40, 1000):
            assert R.distinct_sentences(terms, order, most, alike) == plain(terms, order, most, alike)


def test_thousands_of_picks_take_seconds():
    r = random.Random(2)
    terms = [[f"t{r.randrange(40_000)}" for _ in range(12)] for _ in range(20_000)]
    began = time.process_time()
    assert len(R.distinct_sentences(terms, list(range(len(terms))), 5000, 0.6)) == 5000
    assert time.process_time() - began < 20


def test_material_by_budget(spark):
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice(["Tree", "Graph", "Node"]) if k == 0 else f"word{r.randrange(60)}" for k in range(9)) + "."
    long = [" ".join(sentence() for _ in range(15)) for _ in range(3)]
    rows = [(1, p, t) for p, t in enumerate(long)] + [(2, 0, "Short text here."), (2, 1, " "), (2, 2, " And more. "), (3, 0, None), (4, 0, "")]
    got = {x["doc_id"]: x for x in R.material(spark.createDataFrame(rows, "doc_id long, page int, text string"), 240).collect()}
    assert set(got) == {1, 2} and got[2]["text"] == "[p. 1]\nShort text here.\n\n[p. 3]\nAnd more." and not got[2]["condensed"]
    lines = got[1]["text"].split("\n")
    assert got[1]["condensed"] and got[1]["words"] == 405 and len(lines) == 10
    assert all(line[:7] in ("[p. 1] ", "[p. 2] ", "[p. 3] ") and line[7:] in long[int(line[4]) - 1] for line in lines) and [x[4] for x in lines] == sorted(x[4] for x in lines)


def test_sentences_are_scored_within_their_document(spark):
    """No term is a row of a shuffle, and a text is parted once."""
    docs = spark.createDataFrame([(1, "Red trees grow fast here. Old trees grow slow there. No.\n" * 2), (2, None), (None, "Red trees grow fast here.")], "doc_id long, text string")
    for df in (R.centroid_scores(docs), R.picked(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and plan.count("[-•*▪●]\\s)") == 1
        assert {r["doc_id"] for r in df.collect()} == {1}


def test_pages_are_parsed_part_by_part(spark, monkeypatch):
    from scriptorium.functions import markdown as M

    monkeypatch.setattr(M, "PARSED", 40)
    texts = [None, "", "Some Heading\nwords of a paragraph.", "x = 1;\ny = 2;\n\nSay what it is.", "One line. " * 30, "é" * 50] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).selectExpr("doc_id", "0 AS page", "text")
    got = sorted((r["doc_id"], r["block"], r["type"], r["lang"], r["text"]) for r in M.structure(rows).collect())
    assert got == sorted((d, i, b[0], b[2], b[3]) for d, t in enumerate(texts) for i, b in enumerate(M.page_blocks(t)))


def test_only_questions_are_shuffled(spark, capsys):
    from scriptorium.operators import study

    docs = spark.createDataFrame([(1, "A cache is a small fast memory of it. It keeps what was read. ROM stands for read only memory."), (2, None)], "doc_id long, text string")
    bank = study.question_bank(docs)
    assert sorted((r["type"], r["answer"]) for r in bank.collect()) == [("Definition", "A cache is a small fast memory of it. It keeps what was read."), ("Full form", "ROM stands for read only memory.")]
    bank.explain()
    assert "lead(" not in capsys.readouterr().out
