from __future__ import annotations

from collections import defaultdict

import regex
from pyspark.sql import functions as F

from scriptorium.functions import words as W
from scriptorium.operators import quiz_terms as Q
from scriptorium.operators import retrieval as R
from scriptorium.operators import study
from scriptorium.sources.tables import pages

TEXTS = [
    "PyCharm is a popular editor for Python programmers today. The teachers of Visual Studio met Alan Turing near Berlin in spring. "
    "Students like Visual Studio because PyCharm needs memory. A neural network consists of many layers of simple neurons.\n"
    "Backpropagation computes gradients of the neural network in reverse order. We store rows in MySQL or .NET services (ASP.NET) with C# and C++ code.\n"
    "Normalisation and classification are covered here, and classification matters most of all. HTML5 pages load jquery.js quickly on slow machines.",
    "A Stack is a structure that holds frames of calls. The stack grows when a function calls another function deeply.\fStack frames hold local variables and the Stack pointer of it. "
    "Stack Pointer values move, and so the stack pointer's place changes again. Queue's order differs from that of the Stack (LIFO).",
    "Nothing here.", "", None,
    "ALL TITLE CASE Words Are Here Today Now. Photosynthesis is the process that feeds plants with light energy. Photosynthesis needs chlorophyll, and chlorophyll absorbs light of the sun. Light Reactions follow, then Light Reactions stop.",
]
PLAIN = {*W.STOP_WORDS, *W.GENERIC_WORDS, *W.PLAIN_WORDS}


def word_pattern(t):
    return regex.compile(rf"(?iu)(?<![\p{{L}}\p{{N}}]){regex.escape(t)}(?![\p{{L}}\p{{N}}])")


def brute(whole, facts, keys):
    """Pairs and patterns, a pattern a term, as plain loops."""
    found = {}

    def dull(k):
        return k in PLAIN or regex.fullmatch(r"\d+", k)

    def add(raw, score):
        t = regex.sub(r"['’]s$", "", raw)
        t = regex.sub(r"^[^\p{L}\p{N}.#]+|[^\p{L}\p{N}+#)]+$", "", t).strip()
        if t.endswith(")") and "(" not in t:
            t = t[:-1].strip()
        k = t.lower()
        parts = k.split(" ")
        if len(t) < 2 or len(t) > 40 or len(t.split()) > 4 or all(map(dull, parts)) or dull(parts[0]) or dull(parts[-1]):
            return
        if len(parts) == 1 and regex.fullmatch(r"\p{Ll}+", t) and len(t) < 6:
            return
        if k in found:
            found[k][1] += score
        else:
            at = whole.lower().find(k)
            found[k] = [whole[at : at + len(t)] if at >= 0 else t, score, 0]

    for f in facts:
        m = regex.match(W.DEFINED, f) or regex.match(W.DOING, f)
        if m and len(m[1].split()) <= 4:
            add(m[1], 3)
        tokens = f.split(" ")
        titled = sum(bool(regex.match(r"\p{Lu}", w)) for w in tokens) >= len(tokens) * 0.6
        for i, w in enumerate(tokens):
            name = regex.sub("[,;:()]+", "", w)
            if regex.match(r"^[.]?\p{L}[A-Za-z0-9_.+#-]*$", name) and regex.search(W.TECHNICAL, w):
                add(name, 2)
            elif i and not titled and regex.match(r"^\p{Lu}\p{Ll}{2,}", w):
                after = tokens[i + 1] if i + 1 < len(tokens) else ""
                pair = f"{w} {after}" if regex.match(r"^\p{Lu}\p{Ll}+", after) else ""
                if pair and len(word_pattern(pair).findall(whole)) > 1:
                    add(pair, 2)
                else:
                    add(w, 1)
    for k in keys:
        if " " in k:
            add(k, 2)
        elif len(k) >= 8 and regex.search(W.NOUN_ENDINGS, k):
            add(k, 1)
    for w in dict.fromkeys(regex.findall(r"\p{L}[\p{L}-]{8,}", whole.lower())):
        if regex.search(W.NOUN_ENDINGS, w):
            add(w, 0.5)
    listed = []
    for v in sorted(found.values(), key=lambda v: -v[1])[:250]:
        v[2] = sum(bool(word_pattern(v[0]).search(f)) for f in facts)
        if v[2]:
            listed.append(v)
    kept = [a for a in listed if not any(b is not a and len(b[0]) > len(a[0]) and (b[2] >= a[2] or b[1] >= a[1]) and word_pattern(a[0]).search(b[0]) for b in listed)]
    return [tuple(v) for v in sorted(kept, key=lambda v: (-v[1], v[2]))[:80]]


def test_terms_equal_plain_loops(spark, sf):
    some = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + some)], "doc_id long, text string")
    facts, keys = defaultdict(list), defaultdict(list)
    for r in sorted(study.facts(pages(docs), placed=True).collect(), key=lambda r: (r["doc_id"], r["page"], r["para"], r["i"])):
        facts[r["doc_id"]].append(r["text"])
    for r in R.keywords(docs.withColumn("text", F.replace("text", F.lit("\f"), F.lit("\n"))), 120).orderBy("doc_id", "rank").collect():
        keys[r["doc_id"]].append(r["term"])
    got = defaultdict(list)
    for r in Q.quiz_terms(docs).collect():
        assert r["term"] == r["shown"].lower()
        got[r["doc_id"]].append((r["shown"], r["score"], r["n"]))
    for i, text in enumerate(TEXTS + some):
        want = brute((text or "").replace("\f", "\n"), facts[i], keys[i]) if facts[i] else []
        assert got[i] == [(t, float(s), n) for t, s, n in want]
    names = {t for t, *_ in got[0]}
    assert {"PyCharm", "Visual Studio", "MySQL", "HTML5", "C++", "neural network", "Backpropagation", "Berlin"} <= names and "Studio" not in names
    assert got[1] and not got[2] and not got[3] and not got[4]


def test_questions_find_terms_as_they_are_written(spark):
    docs = spark.createDataFrame([(0, TEXTS[0])], "doc_id long, text string")
    terms = Q.quiz_terms(docs).select("doc_id", "term")
    met = {(r["term"], r["text"]) for r in study.term_facts(study.facts(pages(docs)), terms).collect()}
    want = {(t["term"], f["text"]) for t in terms.collect() for f in study.facts(pages(docs)).collect() if word_pattern(t["term"]).search(f["text"])}
    assert met == want and any(t == "c++" for t, _ in met)


def test_mentions_are_whole_words():
    find = Q.Finder(["net", ".net", "a b", "c++"])
    assert sorted(find("the .net and net, planet a b ab c++ c+++")) == sorted([(4, ".net"), (5, "net"), (13, "net"), (25, "a b"), (32, "c++"), (36, "c++")])
    assert list(Q.Finder([])("text")) == []


def test_facts_meet_terms_without_a_row_a_run(spark):
    facts = spark.createDataFrame([(0, "The neural network learns; a NEURAL  network, too."), (0, "A network of neural cells."), (1, "neural network"), (None, "neural network")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "neural network"), (0, "Neural-Network"), (0, "net"), (0, "a b c d e"), (0, "++"), (1, "network"), (None, "neural")], "doc_id long, term string")
    counts = study.term_mentions(facts, terms)
    assert sorted(map(tuple, counts.collect())) == [(0, "neural network", 1), (1, "network", 1)]
    met = study.term_facts(facts, terms)
    assert sorted((r["doc_id"], r["term"], r["text"][:5]) for r in met.collect()) == [(0, "neural network", "The n"), (1, "network", "neura")]
    for df in (counts, met):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
