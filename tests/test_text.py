from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import models
from scriptorium.functions import counts
from scriptorium.functions import text as T
from scriptorium.operators import folds, fuzzy
from scriptorium.streaming import live


def one(spark, make, *values):
    row = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return row.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("make, text, want", [
    (T.tokenize, "Éa b2-c", ["éa", "b2", "c"]),
    (T.content_terms, "The networks of a bee", ["networks", "bee"]),
    (T.split_sentences, "Deep Learning\nNets learn. They have layers.\n\n- one thing\n- two things", ["Deep Learning", "Nets learn.", "They have layers.", "one thing", "two things"]),
    (T.split_sentences, "Version 2.5 is e.g. fine. Next", ["Version 2.5 is e.g. fine.", "Next"]),
    (T.normalize, "Unit-2", "unit 2"), (T.normalize, "u2", "unit 2"), (T.normalize, "UNIT II", "unit 2"), (T.normalize, "module 02", "unit 2"), (T.normalize, "R & D", "r and d"), (T.normalize, "m1", "m1"),
    (T.stem_search, "normalization", "normal"), (T.stem_search, "normalized", "normal"), (T.stem_search, "queries", "query"), (T.stem_search, "bus", "bus"),
    (T.tidy_title, "MULTIMEDIA IN HTML5", "Multimedia in HTML5"), (T.tidy_title, "Mixed Case", "Mixed Case"),
    (T.heading_of, "a long line that is a sentence and ends here.\nUNIT TWO BASICS\nmore", "Unit TWO basics"),
    (T.detect_language, "SELECT a FROM b", "sql"), (T.detect_language, "#include <x>\nstd::cout", "cpp"),
    (T.plain_text, "# Head\n**bold** [x](y) `c`", "Head bold x c"),
    (T.list_items, "a cat, a dog, and a bird.", ["a cat", "a dog", "a bird"]),
    (T.clean_transcript, "[BLANK_AUDIO] i think i think sql is is good", "I think SQL is good."),
    (T.clean_transcript, "", ""),
    (T.clean_ocr, "net-\nwork  of\n\n\n\nthings", "network of\n\nthings"),
    (T.safe_file_name, 'a/b:"c"', "a b c"), (T.file_extension, "x/y.Tar.GZ", "gz"),
    (T.html_text, "<p>Hi &amp; <b>you</b><script>x()</script></p>", "Hi & you"),
    (T.sanitize_html, '<a onclick="x()" href="javascript:1">t</a><script>1</script>', "<a>t</a>"),
    (T.tech_terms, "I used python, Python and React Native with C++", ["python", "React", "C++"]),
    (T.heading_line, "Deep Learning", True), (T.heading_line, "It ends.", False), (T.word_count, "a  b\nc", 3),
])
def test_functions(spark, make, text, want):
    assert one(spark, make, text) == want


def test_natural_order(spark):
    df = spark.createDataFrame([("Unit 10",), ("unit 2",), ("Unit 1",)], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["Unit 1", "unit 2", "Unit 10"]


def test_clips_blanks_and_citations(spark):
    assert one(spark, lambda c: T.clip_words(c, 10), "hello there world") == "hello…"
    assert one(spark, lambda c: T.clip_words(c, 10), "short") == "short"
    assert one(spark, T.blank_out, "The C++ and c++ code", "c++") == "The _____ and c++ code"
    assert one(spark, T.mentions, "a neural network", "network") and not one(spark, T.mentions, "networks", "network")
    long = " ".join(f"w{i}" for i in range(100))
    assert one(spark, T.clip_around, long, "w50").startswith("…w38 ")
    assert one(spark, T.keep_real_citations, "Yes [p. 1] and no [p. 9].", [1, 2]) == "Yes [p. 1] and no."


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_slips_equal_plain_version(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert fuzzy.slips(a, b) == min(3, d[-1][-1])


def test_word_matches(spark):
    cases = {("sch", "scheduling"): 0.8, ("2", "12"): None, ("algoritm", "algorithm"): 0.68, ("algroithm", "algorithm"): 0.68, ("normalize", "normalization"): 0.92, ("os", "os"): 1.0, ("zzz", "algorithm"): None, ("normlize", "normalization"): 0.62}
    q = spark.createDataFrame([(a,) for a in {a for a, _ in cases}], "q string")
    w = spark.createDataFrame([(b,) for b in {b for _, b in cases}], "w string")
    got = {(r["q"], r["w"]): r["score"] for r in fuzzy.word_matches(q, w).collect()}
    assert {k: got.get(k) for k in cases} == cases


def test_search_of_a_small_tree(spark):
    rows = [("1", "subject", "Operating Systems", None, []), ("2", "folder", "Unit 2", "1", []), ("3", "file", "Scheduling", "2", ["round robin"]), ("4", "subject", "Database Management Systems", None, []), ("5", "file", "Normalization", "4", ["bcnf"]), ("6", "folder", "Unit 12", "1", [])]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, parent_id string, keywords array<string>")
    found = lambda q: [r["id"] for r in fuzzy.search(nodes, q).orderBy("place").collect()]
    assert found("normalisaton")[0] == "5" and found("os unit 2")[0] == "2" and found("dbms")[0] == "4" and "3" in found("round robin")
    assert found("the of") == []


def test_folds():
    assert folds.chunk_numbers([100, 60, 60, 10], 180) == [0, 0, 1, 1]
    assert folds.chunk_numbers([500, 500], 180) == [0, 1] and folds.chunk_numbers([]) == []
    assert folds.part_numbers([10, 20, 300, 5], 100) == [0, 0, 1, 2]
    assert folds.page_numbers([(300, False), (10, True), (200, False)], 450) == [0, 1, 1]
    assert folds.topic_parts([10, 10], 100) == [0, 0] and folds.topic_parts([90, 90, 20], 100) == [0, 1, 1] and folds.topic_parts([90, 90, 40], 100) == [0, 1, 2]
    days = folds.day_numbers([5, 5, 5, 5, 5], 3)
    assert len(days) == 5 and sorted(set(days)) == [0, 1, 2] and folds.day_numbers([1, 1], 9) == [0, 1]


def test_chunks_repeat_the_last_sentence(spark):
    text = " ".join(f"Sentence number {i} has exactly these eight words." for i in range(60))
    pages = spark.createDataFrame([(1, 0, text), (1, 1, ""), (1, 2, "Short one. Next one.")], "doc_id long, page int, text string")
    rows = folds.chunks(pages).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and rows[-1]["page"] == 2
    assert all(r["words"] <= 180 for r in rows)
    assert rows[1]["text"].split("\n")[0] == rows[0]["text"].split("\n")[-1]


def test_recogniser_results(spark):
    said = ["I built", "I built a tool", "tool", "", "and shipped it"]
    assert one(spark, folds.join_recognition, said) == "I built a tool and shipped it" == " ".join(live.fold([], said))


@pytest.mark.parametrize("raw, want", [
    ('```json\n{a: 1, \'b\': [1,2,],}\n```', '{"a": 1, "b": [1, 2]}'), ('text [1, {"x": "cut', '[1, {"x": "cut"}]'), ("none", None), (None, None), ('{"a": 1, "b"', '{"a": 1}'),
])
def test_loose_json(raw, want):
    assert models.loose_json(raw) == want


def test_failing_model_leaves_the_rows(spark):
    class Broken(models.Offline):
        def generate(self, prompts):
            raise RuntimeError("down")

    df = spark.createDataFrame([("a\nb",), (None,)], "prompt string")
    assert [r["reply"] for r in models.generated(df, models.Offline()).collect()] == ["a", ""]
    rows = models.generated(df, Broken()).collect()
    assert len(rows) == 2 and all(r["reply"] is None and "down" in r["error"] for r in rows)


def test_chunks_part_a_text_once(spark):
    """A filter on the parted text would part it a second time."""
    docs = spark.createDataFrame([(1, 0, "One two three. Four five six.\n" * 3)], "doc_id long, page int, text string")
    plan = folds.chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[-•*▪●]\\s)") == 1


def test_chunks_of_a_long_text_take_time_by_its_length(spark):
    said = [f"Word{i} is said here for the {i}th time." for i in range(12_000)]
    docs = spark.createDataFrame([(1, 0, " ".join(said)), (2, 0, None), (3, 0, "")], "doc_id long, page int, text string")
    found = folds.chunks(docs, 16).orderBy("chunk_id").collect()
    spans = folds.chunk_spans([8] * len(said), 16)
    assert [(r.doc_id, r.first_sentence, r.sentences) for r in found] == [(1, a, n) for a, n in spans]
    assert all(r.text == "\n".join(said[r.first_sentence : r.first_sentence + r.sentences]) for r in found)


def test_spans_of_chunks():
    assert folds.chunk_spans([100, 60, 60, 10], 180) == [(0, 2), (1, 3)]
    assert folds.chunk_spans([500, 500], 180) == [(0, 1), (0, 2)] and folds.chunk_spans([]) == []


def test_phrases_of_a_text():
    assert counts.found_phrases("the old red house of 12 the old red 345".split()) == {
        "old": (2.0, 2), "old red": (3.0, 3), "red": (2.0, 4), "red house": (1.5, 5), "house": (1.0, 6), "red 345": (1.5, 17)}
    assert counts.strongest({"old red": (3.0, 3), "old": (2.0, 2), "house": (1.0, 6), "far": (1.0, 9), "off": (1.0, 11)}, 8) == ["old red", "house", "far"]
