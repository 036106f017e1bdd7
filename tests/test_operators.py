from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import markdown as M
from scriptorium.operators import activity, mutations, planning, retrieval, scoring, signal, study, tree
from scriptorium.sources import readers
from scriptorium.sources.tables import pages
from scriptorium.streaming import live

TREE = [("s1", "subject", "Maths", None, "both"), ("f1", "folder", "Unit 10", "s1", "mid"), ("f2", "folder", "Unit 2", "s1", "end"), ("x1", "file", "Notes", "f2", None), ("s2", "subject", "Physics", None, None), ("o", "file", "Orphan", "gone", None)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(TREE, "id string, kind string, name string, parent_id string, exam string")


def test_tree(spark, nodes):
    assert [r["name"] for r in tree.children(nodes).where("parent_id = 's1'").orderBy("position").collect()] == ["Unit 2", "Unit 10"]
    paths = {r["id"]: r["path"] for r in tree.paths(nodes).collect()}
    assert paths["x1"] == "Maths › Unit 2 › Notes" and paths["o"] == "Orphan"
    assert {r["id"] for r in tree.visible(nodes, "mid").collect()} == {"s1", "f1", "s2", "o"}
    assert {r["id"]: r["files"] for r in tree.subtree_counts(nodes).collect()} == {"s1": 1, "f1": 0, "f2": 1, "s2": 0}
    moved = {r["id"]: r for r in tree.move(nodes, "f2", None).collect()}
    assert moved["f2"]["kind"] == "subject" and moved["f2"]["parent_id"] is None and moved["x1"]["parent_id"] == "f2" and len(moved) == len(TREE)
    copied = tree.copy(spark.createDataFrame([(1, "subject", "A", None), (2, "file", "B", 1)], "id long, kind string, name string, parent_id long"), 1, None, "op").collect()
    by = {r["name"]: r for r in copied}
    assert set(by) == {"A (copy)", "B"} and by["B"]["parent_id"] == by["A (copy)"]["id"]
    asked = spark.createDataFrame([("s1", "f1"), ("x1", None), ("f2", "s1"), ("f2", "s2"), ("nope", "s1")], "id string, target string")
    assert [r["problem"] for r in tree.transfer_problem(nodes, asked).orderBy("id", "target").collect()] == ["already there", None, "no such node", "a folder cannot go inside itself", "a file needs a folder"]


def test_cyclic_parents_are_an_error(spark):
    loop = spark.createDataFrame([("a", "folder", "A", "b"), ("b", "folder", "B", "c"), ("c", "folder", "C", "a"), ("d", "file", "D", "a")], "id string, kind string, name string, parent_id string")
    with pytest.raises(tree.Circle):
        tree.closure(loop)
    with pytest.raises(tree.Circle):
        tree.descendants(loop, F.lit("nobody"))


def test_deep_and_wide_trees(spark, nodes):
    deep = spark.createDataFrame([(i, "folder", f"n{i}", i - 1 if i else None) for i in range(200)] + [(500, "file", "x", 7)], "id long, kind string, name string, parent_id long")
    assert tree.closure(deep).count() == 200 * 201 // 2 + 9
    below = {r["id"]: r["depth"] for r in tree.descendants(deep, F.lit(5)).collect()}
    assert below == {i: i - 5 for i in range(5, 200)} | {500: 3}
    assert [r["id"] for r in tree.preorder(nodes, F.lit("s1")).orderBy("place").collect()] == ["s1", "f2", "x1", "f1"]
    wide = spark.range(2_000_000).select("id", F.lit("file").alias("kind"), F.col("id").cast("string").alias("name"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 50)).alias("parent_id"))
    assert tree.descendants(wide, F.lit(1)).groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 50), (2, 2500), (3, 125000)]


def test_audit_is_trimmed_and_batched(spark):
    changes = spark.createDataFrame([("u", i, "n" * 200, "file", "s" * 2000) for i in range(60)], "uid string, id long, name string, kind string, summary string")
    (row,) = tree.audit_entries(changes, "nonsense").collect()
    assert row["action"] == "edit" and len(row["summary"]) == 1000 and len(row["items"]) == 50 and row["count"] == 60 and len(row["items"][0]["name"]) == 120
    parts = tree.audit_entries(changes.withColumn("summary", F.lit("x")), "move", size=25).orderBy("part").collect()
    assert [(r["summary"], r["count"]) for r in parts] == [("x (part 1 of 3)", 25), ("x (part 2 of 3)", 25), ("x (part 3 of 3)", 10)]


def test_fusion_follows_weights(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id long, doc_id long, rank int")
    assert [r["doc_id"] for r in retrieval.fuse([(a, 1.0), (b, 2.0)]).orderBy("rank").collect()] == [2, 3, 1]


def test_answers_come_from_the_text(spark):
    docs = spark.createDataFrame([(1, "Photosynthesis turns light into sugar in the leaf. Cows eat grass every day here."), (2, "Networks of computers talk by protocols all day. Routers forward packets."), (3, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "What is a network protocol?"), (8, "the of")], "query_id long, text string")
    top = retrieval.bm25_stemmed(docs, ask)
    assert [(r["query_id"], r["doc_id"]) for r in top.collect()] == [(7, 2)] and retrieval.bm25(docs, ask).count() == 0
    assert retrieval.best_sentences(docs, top, ask).first()["answer"] == "Networks of computers talk by protocols all day."


def test_summary_is_ordered_and_not_redundant(spark):
    s = ["Graph databases store nodes and edges for traversal queries.", "Relational databases store tables of rows with keys.", "Graph databases store nodes and edges for traversal queries today."]
    docs = spark.createDataFrame([(1, " ".join(s)), (2, ""), (3, None)], "doc_id long, text string")
    rows = retrieval.summarize(docs, 5).orderBy("sent_idx").collect()
    assert len(rows) == 2 and rows[-1]["text"] == s[1] or rows[0]["text"] == s[1]


def test_study_material(spark):
    text = "A neural network consists of layers, weights, and biases. CPU stands for central processing unit. A compiler is a program that translates source code. It runs. Caching helps programs avoid repeated slow work."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bank = study.question_bank(docs).orderBy("n").collect()
    assert [r["type"] for r in bank] == ["List / State", "Full form", "Definition", "Purpose"] and sum(r["important"] for r in bank) == 2
    assert study.flashcards(study.question_bank(docs)).count() == 4
    assert study.facts(pages(docs)).count() == 4
    assert "## Overview" in study.notes(docs).first()["markdown"]


def test_emphasis_and_cards(spark):
    df = spark.createDataFrame([("A graph is a graph of nodes.", ["graph", "node", "nodes"])], "t string, k array<string>")
    assert df.select(study.emphasised(F.col("t"), F.col("k"))).first()[0] == "A **graph** is a graph of **nodes**."


def test_quiz_is_grounded_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = study.quiz_sets(docs, 5).collect(), study.quiz_sets(docs, 5).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    texts = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in docs.collect()}
    for r in a:
        assert r["options"][r["answer"]] == r["term"] and len(set(r["options"])) == 4 and "_____" in r["question"]
        assert r["term"].split()[0] in texts[r["doc_id"]]


def test_grades(spark):
    df = spark.createDataFrame([("match", [1, 2], [1, 3]), ("single", [1], [1]), ("single", [1], [2]), ("match", [1], None)], "kind string, a array<int>, r array<int>")
    assert [r[0] for r in df.select(study.grade(F.col("kind"), F.col("a"), F.col("r"))).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_plan(spark):
    topics = spark.createDataFrame([("g", i, f"t{i}", w) for i, w in enumerate([100, 900, 50, 50, 400, 300])], "g string, i long, title string, words long")
    rows = planning.plan(topics, "g", "i", 5).orderBy("i").collect()
    days = [r["day"] for r in rows]
    assert len(rows) == 6 and days == sorted(days) and set(days) == set(range(1, max(days) + 1)) and max(days) <= 4
    for d in set(days):
        assert sum(r["minutes"] for r in rows if r["day"] == d) <= 105
    review = planning.review_days(planning.plan(topics, "g", "i", 5), "g", 5).collect()
    assert len(review) == 5 - max(days) and sum(r["final"] for r in review) == 1
    with pytest.raises(ValueError):
        planning.plan(topics, "g", "i", 61)


def test_scores_rise_with_structure(spark):
    good = "When I joined the project at my company our search was slow. I designed and built a Python and Redis cache, for example for hot queries, and I measured it each day with the team. As a result latency fell by 40% and 2000 users were happier with it."
    pairs = spark.createDataFrame([(1, "Describe your search project", good), (2, "Describe your search project", "um like it was basically fine"), (3, "q", None)], "id long, question string, answer string")
    rows = {r["id"]: r for r in scoring.answer_scores(pairs.fillna("")).collect()}
    assert rows[1]["band"] == "blue" and rows[2]["band"] == "red" and rows[3]["score"] <= 15
    notes = {r["id"]: r["improvements"] for r in scoring.answer_review(pairs).collect()}
    assert notes[2] == "short,situation,action,result,fillers"


def test_voice_and_merge(spark):
    s = spark.createDataFrame([("a", 60.0, 50.0, 2, 0.8, " ".join(["word"] * 115)), ("b", 2.0, 1.0, 0, None, "x")], "id string, duration_sec double, speaking_sec double, pauses int, steadiness double, transcript string")
    (r,) = scoring.voice_report(s).collect()
    assert r["wpm"] == 138 and r["band"] == "blue"
    m = spark.createDataFrame([("k", 10.0, 8.0, 1, 2.0, 0.5, 0.5), ("k", 10.0, 6.0, 2, 3.0, 0.5, None)], "k string, duration_sec double, speaking_sec double, pauses int, longest_pause_sec double, avg_volume double, steadiness double")
    r = signal.merge_voice(m, "k").first()
    assert (r["duration_sec"], r["speaking_sec"], r["pauses"], r["longest_pause_sec"], r["steadiness"]) == (20.0, 14.0, 3, 3.0, 0.5)


def test_pauses(spark):
    series = [0.1] * 100 + [0.001] * 20 + [0.1] * 100
    loud = spark.createDataFrame([(1, i, x) for i, x in enumerate(series)], "clip_id long, idx int, rms double")
    r = signal.voice_stats(loud).first()
    assert r["pauses"] == 1 and r["longest_pause_sec"] == 2.0 and r["speaking_sec"] == 20.0


def test_resume(spark):
    text = "Ada Byron\nada@example.org\n\nSKILLS\nLanguages: Python, SQL\nEXPERIENCE\nEngineer at Mill\n- Cut build time by 40% for 300 users in 2020\nEDUCATION\nBSc"
    r = scoring.resume_profile(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["name"] == "Ada Byron" and r["email"] == "ada@example.org" and r["skills"][:2] == ["Python", "SQL"] and len(r["metrics"]) == 1


def test_activity_states(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, t), ("blocked", t), ("suspended", datetime(2025, 1, 1)), ("suspended", t)], "k string, until timestamp")
    assert [r[0] for r in df.select(activity.ban_state(F.col("k"), F.col("until"), F.lit(datetime(2024, 6, 1)))).collect()] == [None, "blocked", "suspended", None]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "id long, x string, y int")
    assert sorted(map(tuple, activity.upsert(old, new, "id").collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    zero = activity.zero_filled(old, "x", ["a", "z"], n=F.lit(True))
    assert {r["x"]: r["n"] for r in zero.collect()} == {"a": 1, "z": 0}


def test_change_log(spark):
    log = spark.createDataFrame([(1, "a", "set", {"x": "1"}), (2, "a", "update", {"y": "2"}), (3, "b", "set", {"x": "1"}), (4, "b", "delete", None), (5, "c", "delete", None), (6, "c", "set", {"z": "9"}), (0, "a", "update", {"old": "1"})], "seq long, id string, op string, patch map<string,string>")
    assert {r["id"]: r["fields"] for r in mutations.folded(log).collect()} == {"a": {"x": "1", "y": "2"}, "c": {"z": "9"}}
    df = spark.createDataFrame([(["b2", "b10"],)], "o array<string>")
    assert df.select(mutations.option_edited(F.col("o"), " B2 ", "b10")).first()[0] == ["b2"]
    assert df.select(mutations.interleaved(F.col("o"), F.array(F.lit("x"), F.lit("b2")), 3)).first()[0] == ["b2", "x", "b10"]


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_readers(spark, tmp_path):
    a, w = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    slide = lambda t: f"<p {a}><a:p><a:t>{t}</a:t></a:p></p>"
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    files = {
        "a.txt": b"one\ftwo", "b.pptx": _zip({"ppt/slides/slide10.xml": slide("last"), "ppt/slides/slide2.xml": slide("first")}),
        "c.docx": _zip({"word/document.xml": f"<w:document {w}><w:body>{para('Hello')}{para('World')}</w:body></w:document>"}),
        "d.doc": b"\x00\x01" + "Readable words of an old file".encode("utf-16-le") + b"\xff\x00", "e.pptx": b"broken", "f.exe": b"x",
    }
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    raw = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    rows = sorted(map(tuple, readers.read_files(raw).collect()), key=str)
    by = {}
    for p, _, t, bad in rows:
        by.setdefault(p, []).append(t if bad is None else bad)
    assert by["a.txt"] == ["one", "two"] and by["b.pptx"] == ["first", "last"] and by["c.docx"] == ["Hello\n\nWorld"]
    assert "Readable words" in by["d.doc"][0] and by["e.pptx"][0].startswith("unreadable") and by["f.exe"] == ["type"]


def test_markdown(spark):
    md = "# T\n\npara one\nmore\n\n- a\n1. b\n```py\nx = 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n> q\n---\n![c](u)"
    rows = M.markdown_blocks(spark.createDataFrame([(1, md), (2, None)], "doc_id long, markdown string")).orderBy("block").collect()
    assert [r["type"] for r in rows] == ["heading", "p", "bullet", "number", "code", "table", "quote", "rule", "image"]
    runs = spark.createDataFrame([("a **b** *c* `d`",)], "t string").select(M.inline_runs(F.col("t"))).first()[0]
    assert [(r["text"], r["bold"], r["italic"], r["code"]) for r in runs if r["text"].strip()] == [("a ", False, False, False), ("b", True, False, False), ("c", False, True, False), ("d", False, False, True)]


def test_streams(spark, tmp_path):
    t0 = 1_700_000_000
    rows = [(1, t0), (1, t0 + 100), (1, t0 + 1000), (2, t0)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(src))
    live.drain(live.heartbeat_sessions(stream), str(tmp_path / "w"))
    got = spark.read.parquet(str(tmp_path / "w" / "out"))
    assert sorted((r["user_id"], r["events"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_transcript_stream(spark, tmp_path):
    rows = [("s", i, f"2024-01-01 00:00:{i:02d}", t) for i, t in enumerate(["I built", "I built a tool", "tool", "and shipped"])]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "session string, seq long, ts string, transcript string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("session string, seq long, ts timestamp, transcript string").parquet(str(src))
    q = live.transcripts(stream).writeStream.outputMode("update").format("memory").queryName("said").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("said").collect()[-1]["transcript"] == "I built a tool and shipped"


def test_term_cards_equal_greedy_pick(spark):
    import re

    from scriptorium.operators import study
    from scriptorium.sources.tables import pages

    texts = [
        "Photosynthesis is a process that makes food for green plants with chlorophyll inside. Chlorophyll is a pigment that drives photosynthesis in all green leaves today.",
        "Respiration is a process that burns sugar with oxygen in every cell. Oxygen is a gas that respiration takes from the air around. Glucose is a sugar that respiration and oxygen turn into energy.",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    facts = sorted((r["doc_id"], r["page"], r["text"]) for r in study.facts(pages(docs)).collect())
    terms = sorted(((r["doc_id"], -r["score"], r["n"], r["term"]) for r in study.quiz_terms(docs).collect()))
    for most in (40, 1):
        want, used = [], set()
        for d, _, _, term in terms:
            free = [f for f in facts if f[0] == d and f not in used and re.search(rf"\b{re.escape(term)}\b", f[2], re.I)]
            if free and sum(x[0] == d for x in want) < most:
                used.add(free[0])
                want.append((d, term))
        got = sorted((r["doc_id"], r["term"]) for r in study.term_cards(docs, most).collect())
        assert got == sorted(want)
        assert len(got) == (4 if most == 40 else 2)  # oxygen and respiration, which is the stronger, leave glucose no fact
