"""Sentences and facts found by a pass over a text equal those of column expressions; nothing of a document is shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import counts as C
from scriptorium.functions import sentences as Z
from scriptorium.functions import text as T
from scriptorium.functions import words as W
from scriptorium.functions.counts import rows
from scriptorium.operators import exam, study

PIECES = ["Nets", "learn", "ähnlich", "Über", "2.5", "3)", "(see", "a)", "-", "•", "* item", "end.", "why?", "no!", "so:", "\n", "\n\n", "\r\n", "\t", "  ", "\x0b", "\f", "\xa0", " ", "Éa", "ǅ", "一", "x", ".", "-x", "𝒳", "½", "of the", "structure that holds", "layers of nodes", "\u0085", "DEEP NETS"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", ""]) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    return [*made, None, "", " ", "\n", "A", "Ab", "Heading Here\nText of it.", "x.  Y"]


def test_sentences_equal_expressions(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in docs.select("t", T.split_sentences(F.col("t")).alias("want"), Z.split(F.col("t")).alias("got"), T.heading_line(F.coalesce("t", F.lit(""))).alias("head")).collect():
        assert r["got"] == r["want"] == Z.sentences(r["t"])
        assert Z.heading(r["t"] or "") == r["head"]


def test_facts_equal_expressions(spark, texts):
    """The facts as they were found by expressions, a paragraph a row."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pages = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "text"))
    split = study.paragraphs(pages).select("doc_id", "page", "para", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "s"))
    s = split.withColumn("text", T.strip(F.regexp_replace("s", r"^[\d.)\s]+(?=\p{L})", "")))
    good = s.where(T.word_count(F.col("text")).between(5, 70) & (F.regexp_count("text", F.lit(r"\p{L}")) >= F.length("text") * 0.55))
    first = good.groupBy("doc_id", F.lower("text").alias("k")).agg(F.min(F.struct("page", "para", "i", "text")).alias("f")).select("doc_id", "f.*")
    want = sorted(map(tuple, first.collect()))
    assert len(want) > 300 and [(i, *f) for i, t in enumerate(texts) for f in Z.facts(t)] == want
    assert sorted((r["doc_id"], r["page"], r["para"], r["i"], r["text"]) for r in study.facts(pages, placed=True).collect()) == want


def test_leading_phrases_equal_all_phrases(sf, spark):
    rng = random.Random(1)
    words = [["the", "net", "nets", "deep", "layer", "12", "2024", "graph", "of", "ab"][min(9, int(rng.expovariate(0.4)))] for _ in range(4000)]
    for size in (0, 1, 2, 5, 30, 400):
        for n in (1, 2, 3, 8, 120):
            for at in range(0, 3000, 300):
                some = words[at : at + size]
                assert C.leading(some, n) == C.strongest(C.found_phrases(some), n)


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_terms_of_a_document_are_found_within_its_row(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("A stack is a structure that holds frames. Frames hold the stack of calls.").alias("text"))
    assert shuffles(study.quiz_terms(docs)) == 0 and study.quiz_terms(docs).count() > 0


def test_cards_of_a_document_are_picked_within_its_row(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("A stack is a structure that holds frames. Frames hold the stack of calls.").alias("text"))
    assert shuffles(study.term_cards(docs)) == 0 and study.term_cards(docs).count() > 0


def test_sets_of_a_document_are_dealt_within_its_row(spark):
    text = "A stack frame is a structure that holds calls. A binary tree holds the frames of a hash table. A hash table and a weighted graph hold a stack frame. A weighted graph is a binary tree of calls."
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    assert shuffles(study.quiz_sets(docs)) == 0 and study.quiz_sets(docs).count() > 0


def test_notes_of_a_document_are_made_within_its_row(spark):
    text = "Stack Frames\nA stack frame is a structure that holds calls. A binary tree holds the frames of a hash table.\fHash Tables\nA hash table is a graph of frames. The stack frame is held by a weighted graph of nodes."
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    for df in (exam.notes(docs), exam.key_terms(docs), exam.sections(docs), exam.paged_sentences(docs)):
        assert shuffles(df) == 0 and {r["doc_id"] for r in df.collect()} == {0, 1, 2}


def test_titles_equal_expressions(spark):
    titles = ["A TALE OF TWO API CALLS", "Unit 2", "UNIT 2 HTTP/2 AND X", "ÜBER ALLES", "the end", "ßA", "ON THE A", "DEEP  NETS\tHERE"]
    for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.tidy_title(F.col("t")).alias("want")).collect():
        assert Z.tidy_title(r["t"]) == r["want"]


def test_sections_meet_within_their_document_row(spark):
    one = "Stack Frames\nA stack frame is a structure that holds calls. A binary tree holds the frames of a hash table. It includes nodes, edges, and labels.\nHash Tables\nA hash table is a graph of frames. The stack frame is held by a weighted graph of nodes."
    docs = spark.createDataFrame([(1, one), (2, None), (None, one)], "doc_id long, text string")
    known = docs.select("doc_id", rows(exam._examined, exam._EXAMINED, "text").alias("x")).select("doc_id", "x.*")
    eight = exam.eight_marks(known)
    assert shuffles(eight) == 0
    asked = {(r["doc_id"], r["question"]) for r in eight.collect()}
    assert {q for i, q in asked if i == 1} == {"Discuss Stack Frames and Hash Tables in detail.", "Compare and contrast Stack Frames and Hash Tables."} and not any(i == 2 for i, _ in asked)
    assert {r["doc_id"]: len(r["said"]) for r in known.collect()} == {1: 3, 2: 0, None: 3} and {x["answer"] for r in known.where("doc_id = 1").collect() for x in r["lists"]} == {"It includes nodes, edges, and labels."}


def test_patterns_fitted_to_a_text_match_as_whole_ones(spark, texts):
    """What is left out of a class is in none of the text."""
    some = [x for t in texts for x in Z.sentences(t)] + ["The deep net is a net.", "Über nets includes a, b, and c.", "𝒳 nets helps all."]
    for p in (W.SUBJECT, W.LIST, W.PURPOSE, W.CLAUSE, W.DOING, r"\p{L}[\p{L}-]{3,}"):
        for x in some:
            a, b = Z.compiled(p).match(x), Z.fit(x, p).match(x)
            assert (a and a.span()) == (b and b.span())


def test_a_bank_shuffles_no_other_sentence(spark):
    """Sentences that no pattern fits don't leave Python."""
    assert study._could_ask("We met. A cache is a small memory. It rained. ROM stands for read only memory.") == [(1, "A cache is a small memory.", "It rained."), (3, "ROM stands for read only memory.", None)]
    assert study._could_ask(None) == []
