from __future__ import annotations

from scriptorium.operators import study


def test_a_definition_is_supported_from_its_own_page(spark):
    text = "A stack is a structure that holds frames of calls. It grows downwards.\fA queue is a structure that serves the first item first.\fIt has two ends."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["n"], r["answer"]) for r in study.question_bank(docs).orderBy("n").collect()]
    assert got == [(1, "A stack is a structure that holds frames of calls. It grows downwards."), (2, "A queue is a structure that serves the first item first.")]
