from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import seeded
from scriptorium.operators import grounding as G

M = 0xFFFFFFFF


def numbers(seed):
    a = seed & M or 1
    while True:
        a = (a + 0x6D2B79F5) & M
        t = ((a ^ a >> 15) * (a | 1)) & M
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & M)) & M
        yield ((t ^ t >> 14) & M) / 4294967296


def seed_of(text):
    h = 2166136261
    b = text.encode("utf-16-be")
    for i in range(0, len(b), 2):
        h = ((h ^ (b[i] << 8 | b[i + 1])) * 16777619) & M
    return h


def mixed(items, seed):
    out, r = list(items), numbers(seed)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(r) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def test_the_generator_counts(spark):
    seeds = [0, 1, 2, 42, 2**31, 2**32 - 1, 2**32, 123456789]
    df = spark.createDataFrame([(s, k) for s in seeds for k in range(6)], "s long, k int")
    got = {(r["s"], r["k"]): r["x"] for r in df.select("s", "k", seeded.number(F.col("s"), F.col("k")).alias("x")).collect()}
    for s in seeds:
        assert [got[s, k] for k in range(6)] == list(itertools.islice(numbers(s), 6))
    # known numbers of seed 1
    assert [got[1, k] for k in range(3)] == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522], abs=1e-15)


def test_shuffles_and_hashes_number_for_number(spark):
    rows = [(list(range(n)), s) for n in (0, 1, 2, 3, 7, 30) for s in (0, 1, 9, 2**32 - 1)]
    got = spark.createDataFrame(rows, "a array<int>, s long").select("a", "s", seeded.shuffled(F.col("a"), F.col("s")).alias("b")).collect()
    assert all(r["b"] == mixed(r["a"], r["s"]) for r in got) and any(r["b"] != r["a"] for r in got)
    texts = ["", "a", "term|other", "naïve", "日本", "😀 x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", seeded.hashed(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [seed_of(t or "") for t in texts]


Q = "question_id long, doc_id long, type string, prompt string, options array<string>, answer int, truth boolean, pairs array<struct<term:string,clue:string>>, page int, explain string"
TEXT = "PyCharm is an\n editor. Back-propagation trains  neural networks.\fStacks hold frames; C++ compiles."


def question(i, kind="blank", doc=1, options=("PyCharm", "b", "c", "d"), answer=0, prompt="p", truth=None, pairs=None, page=1):
    return (i, doc, kind, prompt, list(options) if options else None, answer, truth, pairs, page, None)


def test_what_the_document_does_not_speak_of_is_refused(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    pair = lambda *t: [(x, f"clue of {x}") for x in t]
    cases = [
        (question(1), True), (question(2, options=("Eclipse", "b", "c", "d")), False), (question(3, options=("PyCharm (Community Edition)", "b", "c", "d")), True),
        (question(4, options=("trains neural networks", "b", "c", "d")), True), (question(5, options=("editor stacks frames unknown", "b", "c", "d"), kind="term"), True),
        (question(6, options=("editor stacks unknown other", "b", "c", "d"), kind="term"), False), (question(7, options=("Eclipse", "b", "c", "d"), kind="mcq"), True),
        (question(8, options=("a", "a", "c", "d"), kind="mcq"), False), (question(9, options=("a", "b", "c"), kind="mcq"), False), (question(10, answer=4, kind="mcq"), False),
        (question(11, kind="essay"), False), (question(12, kind="tf", truth=True), True), (question(13, kind="tf"), False), (question(14, kind="tf", truth=False, prompt=""), False),
        (question(15, kind="match", pairs=pair("PyCharm", "stacks", "frames")), True), (question(16, kind="match", pairs=pair("PyCharm", "stacks")), False),
        (question(17, kind="match", pairs=pair("PyCharm", "stacks", "frames", "unheard")), False), (question(18, kind="match", pairs=pair("PyCharm", "stacks", "frames", "c++", "unheard")), True),
        (question(19, doc=9), False), (question(20, doc=2), False), (question(21, kind="mcq", prompt=None), False), (question(22, kind="correct", prompt=None), True), (question(23, answer=None), False),
        (question(24, kind=None), False), (question(25, kind="mcq", options=None), False),
    ]
    many = [question(1000 + i) for i in range(700)]  # over more than one copy of the text
    got = {r["question_id"]: r for r in G.grounded(spark.createDataFrame([c for c, _ in cases] + many, Q), docs).collect()}
    assert {i for i in got if i < 1000} == {c[0] for c, stands in cases if stands} and sum(i >= 1000 for i in got) == 700
    assert got[12]["options"] == ["True", "False"] and got[12]["answer"] == [0] and got[12]["prompt"] == "True or false? “p”"
    m = got[15]
    order = mixed([0, 1, 2], seed_of("PyCharm|stacks|frames"))
    assert m["options"] == [f"clue of {m['terms'][i]}" for i in order] and [m["options"][i] for i in m["answer"]] == [f"clue of {t}" for t in m["terms"]]
    assert len(got[18]["terms"]) == 4


def test_pages_stay_in_the_document(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    rows = [question(i, kind="mcq", page=p) for i, p in enumerate([None, 0, 1, 2, 9, -4])]
    assert [r["page"] for r in G.grounded(spark.createDataFrame(rows, Q), docs).orderBy("question_id").collect()] == [0, 0, 0, 1, 1, 0]


def one_by_one(questions, figures):
    """The sequential rule: questions in order, each takes what isn't shown yet."""
    import re

    shown = {(d, f) for d, *_, a in questions for f in re.findall(r"\(image:([^)\s]+)\)", a or "")}
    out = []
    for d, q, _, page, answer in sorted(questions, key=lambda r: (r[2], r[1])):
        ids = re.findall(r"\(image:([^)\s]+)\)", answer or "")
        out += [(d, q, f, True, k) for k, f in enumerate(ids)]
        if not ids:
            free = [f for e, f, p, at in sorted(figures, key=lambda r: (r[3], r[1])) if e == d and p == page and (d, f) not in shown][:2]
            shown |= {(d, f) for f in free}
            out += [(d, q, f, False, k) for k, f in enumerate(free)]
    return sorted(out)


def test_figures_go_where_the_sequential_rule_puts_them(spark):
    r = random.Random(3)
    questions = [(i % 3, i, r.randrange(50), r.choice([0, 1, 2, None]), r.choice([None, "text", f"see ![x](image:f{r.randrange(30)})", f"(image:f{r.randrange(30)}) (image:f{r.randrange(30)})"])) for i in range(60)]
    figures = [(d, f"f{k}", r.choice([0, 1, 2]), r.randrange(9)) for d in range(3) for k in range(30)]
    got = G.figures_for(spark.createDataFrame(questions, "doc_id long, question_id long, shown_at int, page int, answer string"), spark.createDataFrame(figures, "doc_id long, figure_id string, page int, shown_at int"))
    assert sorted(tuple(x) for x in got.collect()) == one_by_one(questions, figures)
