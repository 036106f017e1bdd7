"""Registered queries of the kept chunk index, with their check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk_index, folds
from ..operators import retrieval as R
from ..sources.scratch import shared
from ..sources.tables import pages, spread, table
from . import sql as S
from .retrieval import ORACLES as _R


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _whole(spark, d):
    return _docs(spark, d).select("doc_id", F.lit(0).alias("chunk_id"), "text")


def indexed_bm25(spark, d):
    """Whole documents as chunks: what ``bm25_topk`` gives by a scan."""
    folder = shared(spark, "index")
    chunk_index.update(_whole(spark, d), folder)
    return chunk_index.search(spark, folder, _asked(spark, d)).select("query_id", "doc_id", "score", "rank")


def chunk_bm25(spark, d):
    folder = shared(spark, "index")
    chunk_index.update(folds.chunks(pages(_docs(spark, d))), folder)
    return chunk_index.search(spark, folder, _asked(spark, d))


def updated_bm25(spark, d):
    """The index of other texts, first with some documents missing and then of all as they are."""
    folder = shared(spark, "index")
    docs = _whole(spark, d)
    other = F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text"))
    chunk_index.update(docs.withColumn("text", other).where("doc_id % 7 <> 0").unionByName(docs.selectExpr("doc_id", "chunk_id + 1 AS chunk_id", "text").where("doc_id % 10 = 0")), folder)
    chunk_index.update(docs, folder)
    return chunk_index.search(spark, folder, _asked(spark, d)).select("query_id", "doc_id", "score", "rank")


def chunk_answers(spark, d):
    folder = shared(spark, "index")
    chunk_index.update(folds.chunks(pages(_docs(spark, d))), folder)
    asked = _asked(spark, d)
    return chunk_index.answers(spark, folder, chunk_index.search(spark, folder, asked, 4), asked)


def summary_material(spark, d):
    """What a model on a device gets of each document; a form feed starts a page."""
    return R.material(pages(_docs(spark, d)), R.BUDGETS["local"]).select("doc_id", "words", "condensed", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (summary_material, indexed_bm25, chunk_bm25, updated_bm25, chunk_answers)}

_PAGES = """pg AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS page FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(12)) AS x FROM documents))"""
_CHUNKS = f"""{_PAGES},
n AS (SELECT doc_id, page, x, list_transform(x, lambda s: {S.word_count("s")}) AS w FROM (SELECT doc_id, page, {S.sentences("text")} AS x FROM pg)),
f(doc_id, page, i, c, words, start) AS (
  SELECT doc_id, page, 1, 0, w[1], 1 FROM n WHERE len(w) > 0
  UNION ALL
  SELECT f.doc_id, f.page, f.i + 1, CASE WHEN f.words + n.w[f.i + 1] > 180 THEN f.c + 1 ELSE f.c END,
    CASE WHEN f.words + n.w[f.i + 1] > 180 THEN n.w[f.i] ELSE f.words END + n.w[f.i + 1], CASE WHEN f.words + n.w[f.i + 1] > 180 THEN f.i ELSE f.start END
  FROM f JOIN n ON f.doc_id = n.doc_id AND f.page = n.page WHERE f.i < len(n.w)),
g AS (SELECT doc_id, page, c, min(start) AS a, max(i) AS b FROM f GROUP BY ALL),
ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, c) - 1 AS INTEGER) AS chunk_id, array_to_string(x[a:b], chr(10)) AS text FROM g JOIN n USING (doc_id, page)),
d AS (SELECT doc_id, chunk_id, {S.content("text")} AS terms FROM ch),
q AS (SELECT DISTINCT item_id AS query_id, unnest({S.content("text")}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM d),
tf AS (SELECT doc_id, chunk_id, length, term, count(*) AS f FROM (SELECT doc_id, chunk_id, len(terms) AS length, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, chunk_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * length / avg_len))), 9) AS full_score
       FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT query_id, doc_id, chunk_id, round(full_score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, doc_id, chunk_id) AS INTEGER) AS rank FROM sc WHERE full_score > 0)"""

ORACLES = {
    "indexed_bm25": _R["bm25_topk"],
    "updated_bm25": _R["bm25_topk"],
    "chunk_bm25": f"WITH RECURSIVE {_CHUNKS} SELECT query_id, doc_id, chunk_id, score, rank FROM r WHERE rank <= 5",
    "chunk_answers": f"""WITH RECURSIVE {_CHUNKS},
        t0 AS (SELECT query_id, doc_id, chunk_id, {S.sentences("ch.text")} AS x FROM r JOIN ch USING (doc_id, chunk_id) WHERE rank = 1),
        t AS (SELECT query_id, doc_id, chunk_id, unnest(x) AS text, generate_subscripts(x, 1) AS i FROM t0),
        u AS (SELECT * FROM (SELECT *, {S.word_count("text")} >= 5 AS long, bool_or({S.word_count("text")} >= 5) OVER (PARTITION BY query_id) AS has_long FROM t) WHERE long OR NOT has_long),
        qq AS (SELECT query_id, list(DISTINCT regexp_replace(term, '(ing|ed|es|s)$', '')) AS stems FROM q GROUP BY query_id),
        h AS (SELECT u.*, len(list_filter({S.content("u.text")}, lambda t: list_contains(stems, regexp_replace(t, '(ing|ed|es|s)$', '')))) AS hits FROM u JOIN qq USING (query_id)),
        m AS (SELECT *, max(hits) OVER (PARTITION BY query_id) > 0 AS hit FROM h),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN hit THEN -hits ELSE 0 END, i) AS k FROM m WHERE hits > 0 OR NOT hit),
        a AS (SELECT query_id, doc_id, chunk_id, string_agg(text, ' ' ORDER BY i) AS answer FROM k WHERE k <= 3 GROUP BY ALL)
        SELECT i.query_id, doc_id, chunk_id, answer FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) i LEFT JOIN a USING (query_id)""",
}
