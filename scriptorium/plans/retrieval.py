"""Registered queries of text and retrieval, with their check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds, study
from ..operators import retrieval as R
from ..sources.tables import lines, pages, spread, table
from . import sql as S


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def token_counts(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(T.tokenize(c)).cast("long").alias("tokens"), F.size(T.content_terms(c)).cast("long").alias("content_terms"), T.word_count(c).cast("long").alias("words"))


def term_frequency(spark, d):
    return R.term_frequency(_docs(spark, d))


def document_frequency(spark, d):
    return R.document_frequency(_docs(spark, d))


def corpus_stats(spark, d):
    return R.corpus_stats(_docs(spark, d)).select("n", F.round("avg_len", 6).alias("avg_len"))


def stem_variants(spark, d):
    words = R.document_frequency(_docs(spark, d)).select("term")
    t = F.col("term")
    return words.select("term", T.stem_light(t).alias("light"), T.stem_search(t).alias("search"), T.stem_prefix(t).alias("prefix"))


def sentence_stats(spark, d):
    s = R.sentences(_docs(spark, d))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(T.word_count(F.col("text"))).cast("long").alias("words"), F.max(F.length("text")).cast("long").alias("longest"))


def sentences_long(spark, d):
    return R.sentences(_docs(spark, d)).where(T.word_count(F.col("text")) >= 20)


def heading_lines(spark, d):
    return lines(_docs(spark, d)).where(T.heading_line(F.col("line"))).select("doc_id", "line_no", "line")


def heading_of(spark, d):
    return _docs(spark, d).select("doc_id", T.heading_of(F.col("text")).alias("heading"))


def tidy_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", T.tidy_title(F.upper("p_name")).alias("title"))


def paragraph_fold(spark, d):
    return study.paragraphs(pages(_docs(spark, d))).select("doc_id", "para", "text")


def chunk_assign(spark, d):
    return folds.chunks(pages(_docs(spark, d))).select("doc_id", "chunk_id", "first_sentence", "sentences", F.col("words").cast("long").alias("words"))


def part_fill(spark, d):
    return folds.parts(_docs(spark, d), 3000)


def context_pack(spark, d):
    as_pages = lines(_docs(spark, d)).select("doc_id", F.col("line_no").alias("page"), F.col("line").alias("text"))
    return folds.context_pack(as_pages, 2000)


def bm25_topk(spark, d):
    return R.bm25(_docs(spark, d), _asked(spark, d)).select("query_id", "doc_id", "score", "rank")


def bm25_stem_fallback(spark, d):
    return R.bm25_stemmed(_docs(spark, d), _asked(spark, d)).select("query_id", "doc_id", "score", "rank")


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_top(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))


def relevance_scale(spark, d):
    return vector_topk(spark, d).select("query_id", "vec_id", R.semantic_relevance(F.col("score")).alias("relevance"))


def rrf_fuse(spark, d):
    docs, asked = _docs(spark, d), _asked(spark, d)
    known = R.matched(docs, asked)
    exact, stemmed = R.bm25(docs, asked, 8, known), R.bm25_stemmed(docs, asked, 8, known)
    return R.fuse([(exact, 1.0), (stemmed, 1.25)], 5).select("query_id", "doc_id", "score", "rank")


def best_sentences(spark, d):
    ranked = R.bm25(_docs(spark, d), _asked(spark, d), 1)
    return R.best_sentences(_docs(spark, d), ranked, _asked(spark, d))


def answer_sources(spark, d):
    return R.answer_sources(R.bm25(_docs(spark, d), _asked(spark, d), 4))


def sentence_centroid_scores(spark, d):
    return R.centroid_scores(_docs(spark, d)).select("doc_id", "sent_idx", "score")


def summaries(spark, d):
    return R.summarize(_docs(spark, d))


def keyword_candidates(spark, d):
    return R.keyword_candidates(_docs(spark, d)).select("doc_id", "term", "weight", F.col("first_pos").cast("long").alias("first_pos"))


def keywords_greedy(spark, d):
    return R.keywords(_docs(spark, d))


def acronyms(spark, d):
    return R.acronyms(_docs(spark, d))


def frequent_words(spark, d):
    return R.frequent_words(_docs(spark, d))


def file_keywords(spark, d):
    return R.file_keywords(_docs(spark, d))


def blank_pages(spark, d):
    return lines(_docs(spark, d)).groupBy("doc_id").agg(F.count_if(T.is_blank_page(F.col("line"))).alias("blank"), F.count("*").alias("pages")).withColumn("all_ocr", F.col("blank") * 2 > F.col("pages"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.sanitize_html(F.col("html")).alias("html"))


def normalized_sources(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize(F.concat(F.lit("Unit-"), F.col("doc_id") % 12, F.lit(" & "), "source")).alias("name"), T.initials(T.search_tokens(F.concat_ws(" ", "lang", "source"))).alias("initials"))


QUERIES = {f.__name__: f for f in (
    token_counts, term_frequency, document_frequency, corpus_stats, stem_variants, sentence_stats, sentences_long, heading_lines, heading_of, tidy_titles, paragraph_fold, chunk_assign,
    part_fill, context_pack, bm25_topk, bm25_stem_fallback, vector_topk, relevance_scale, rrf_fuse, best_sentences, answer_sources, sentence_centroid_scores, summaries,
    keyword_candidates, keywords_greedy, acronyms, frequent_words, file_keywords, blank_pages, html_text, html_clean, normalized_sources,
)}

_LINES = "l AS (SELECT doc_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))"


_STEMMED = f"""
d AS (SELECT doc_id, {S.content("text")} AS terms FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({S.content("text")}) AS term FROM benchmark),
qs AS (SELECT query_id, term, regexp_replace(term, '(ing|ed|es|s)$', '') AS stem FROM q),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM d),
w AS (SELECT doc_id, length, word, regexp_replace(word, '(ing|ed|es|s)$', '') AS stem, count(*) AS f, min(pos) AS first
      FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS word, generate_subscripts(terms, 1) AS pos FROM d) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM w GROUP BY word),
h AS (SELECT query_id, term, doc_id, length, f, df, row_number() OVER (PARTITION BY query_id, term, doc_id ORDER BY CASE WHEN word = term THEN 0 ELSE 1 END, first) AS k
      FROM qs JOIN w USING (stem) JOIN df USING (word)),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * length / avg_len))), 9) AS full_score
       FROM h, st WHERE k = 1 GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(full_score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE full_score > 0)"""

_VECTORS = """
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS full_score
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, round(full_score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, vec_id) AS INTEGER) AS rank FROM p WHERE full_score > 0.2)"""

_KEYS = f"""
t AS (SELECT doc_id, {S.tokens("text")} AS ts FROM documents),
e AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i, unnest(list_append(ts[2:], NULL)) AS nx FROM t),
k AS (SELECT *, length(w) > 2 AND NOT list_contains({S.STOP}, w) AS kw, nx IS NOT NULL AND length(nx) > 2 AND NOT list_contains({S.STOP}, nx) AS kn FROM e),
u AS (SELECT doc_id, w AS term, 1.0::DOUBLE AS x, 2 * (i - 1) AS pos FROM k WHERE kw AND NOT regexp_matches(w, '^\\d+$')
      UNION ALL SELECT doc_id, w || ' ' || nx, 1.5::DOUBLE, 2 * (i - 1) + 1 FROM k WHERE kw AND kn),
c AS (SELECT doc_id, term, sum(x) AS weight, CAST(min(pos) AS BIGINT) AS first_pos FROM u GROUP BY ALL)"""

_SIZES = f"""
n AS (SELECT doc_id, list_transform(x, lambda s: {S.word_count("s")}) AS w FROM (SELECT doc_id, {S.sentences("text")} AS x FROM documents)),"""

ORACLES = {
    "token_counts": f"SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS tokens, CAST(len({S.content('text')}) AS BIGINT) AS content_terms, {S.word_count('text')} AS words FROM documents",
    "term_frequency": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.content('text')}) AS term FROM documents) GROUP BY ALL",
    "document_frequency": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.content('text')}) AS term FROM documents) GROUP BY ALL",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({S.content('text')})), 6) AS avg_len FROM documents",
    "stem_variants": f"""SELECT term, regexp_replace(term, '(ing|ed|es|s)$', '') AS light, {S.stem_search('term')} AS search, left(term, 5) AS prefix
        FROM (SELECT DISTINCT unnest({S.content("text")}) AS term FROM documents)""",
    "sentence_stats": f"WITH {S.SENTENCES} SELECT doc_id, count(*) AS sentences, CAST(sum({S.word_count('text')}) AS BIGINT) AS words, CAST(max(length(text)) AS BIGINT) AS longest FROM s GROUP BY doc_id",
    "sentences_long": f"WITH {S.SENTENCES} SELECT doc_id, sent_idx, text FROM s WHERE {S.word_count('text')} >= 20",
    "heading_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE {S.heading('line')}",
    "paragraph_fold": rf"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
          regexp_split_to_array(coalesce(text, ''), '\n+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS x FROM documents)),
        b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l),
        m AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND NOT regexp_matches(prev, '[.!?:]$') AND regexp_matches(line, '^[\p{{Ll}}(]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b)
        SELECT doc_id, CAST(g - 1 AS BIGINT) AS para, string_agg(line, ' ' ORDER BY i) AS text FROM m GROUP BY doc_id, g""",
    "chunk_assign": f"""WITH RECURSIVE {_SIZES}
        f(doc_id, i, c, words, start, fresh) AS (
          SELECT doc_id, 1, 0, w[1], 1, 1 FROM n WHERE len(w) > 0
          UNION ALL
          SELECT f.doc_id, f.i + 1,
            CASE WHEN f.words + n.w[f.i + 1] > 180 THEN f.c + 1 ELSE f.c END,
            CASE WHEN f.words + n.w[f.i + 1] > 180 THEN n.w[f.i] ELSE f.words END + n.w[f.i + 1],
            CASE WHEN f.words + n.w[f.i + 1] > 180 THEN f.i ELSE f.start END, 1
          FROM f JOIN n ON f.doc_id = n.doc_id WHERE f.i < len(n.w))
        SELECT doc_id, CAST(c AS INTEGER) AS chunk_id, CAST(min(start) - 1 AS INTEGER) AS first_sentence, CAST(max(i) - min(start) + 1 AS INTEGER) AS sentences, CAST(max(words) AS BIGINT) AS words
        FROM f GROUP BY doc_id, c""",
    "part_fill": """WITH RECURSIVE n AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS w FROM documents),
        f(doc_id, i, p, size) AS (
          SELECT doc_id, 1, 0, w[1] FROM n
          UNION ALL
          SELECT f.doc_id, f.i + 1, CASE WHEN f.size + n.w[f.i + 1] > 3000 THEN f.p + 1 ELSE f.p END, CASE WHEN f.size + n.w[f.i + 1] > 3000 THEN 0 ELSE f.size END + n.w[f.i + 1]
          FROM f JOIN n ON f.doc_id = n.doc_id WHERE f.i < len(n.w))
        SELECT doc_id, CAST(p AS INTEGER) AS part, count(*) AS items, CAST(max(size) AS BIGINT) AS size FROM f GROUP BY doc_id, p""",
    "context_pack": f"""WITH {_LINES}, z AS (SELECT doc_id, line_no, CAST(length({S.strip("line")}) AS BIGINT) AS n FROM l),
        r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS total FROM z)
        SELECT doc_id, line_no AS page, n AS n_chars FROM r WHERE total <= 2000""",
    "bm25_topk": f"WITH {S.BM25} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5",
    "bm25_stem_fallback": f"WITH {_STEMMED} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5",
    "vector_topk": f"WITH {_VECTORS} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 8",
    "relevance_scale": f"WITH {_VECTORS} SELECT query_id, vec_id, CAST(floor(least(greatest((score - 0.15) / 0.45, 0), 1) * 100 + 0.5) AS BIGINT) AS relevance FROM r WHERE rank <= 8",
    "rrf_fuse": f"""WITH a AS (WITH {S.BM25} SELECT * FROM r WHERE rank <= 8), b AS (WITH {_STEMMED} SELECT * FROM r WHERE rank <= 8),
        u AS (SELECT query_id, doc_id, 1.0 / (59 + rank) AS g FROM a UNION ALL SELECT query_id, doc_id, 1.25 / (59 + rank) FROM b),
        s AS (SELECT query_id, doc_id, round(sum(CAST(g AS DOUBLE)), 9) AS score FROM u GROUP BY ALL),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 5""",
    "best_sentences": f"""WITH {S.BM25}, {S.SENTENCES[1:]},
        t AS (SELECT r.query_id, r.doc_id, s.sent_idx, s.text, {S.word_count("s.text")} >= 5 AS long FROM r JOIN s ON r.doc_id = s.doc_id WHERE rank = 1),
        u AS (SELECT * FROM (SELECT *, bool_or(long) OVER (PARTITION BY query_id, doc_id) AS has_long FROM t) WHERE long OR NOT has_long),
        qq AS (SELECT query_id, list(DISTINCT regexp_replace(term, '(ing|ed|es|s)$', '')) AS stems FROM q GROUP BY query_id),
        h AS (SELECT u.*, len(list_filter({S.content("u.text")}, lambda t: list_contains(stems, regexp_replace(t, '(ing|ed|es|s)$', '')))) AS hits FROM u JOIN qq USING (query_id)),
        m AS (SELECT *, max(hits) OVER (PARTITION BY query_id, doc_id) > 0 AS hit FROM h),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY CASE WHEN hit THEN -hits ELSE 0 END, sent_idx) AS k FROM m WHERE hits > 0 OR NOT hit)
        SELECT query_id, doc_id, string_agg(text, ' ' ORDER BY sent_idx) AS answer FROM n WHERE k <= 3 GROUP BY ALL""",
    "answer_sources": f"""WITH {S.BM25}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r WHERE rank <= 4),
        n AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS source_no FROM t WHERE score >= best * 0.5)
        SELECT * FROM n WHERE source_no <= 3""",
    "sentence_centroid_scores": f"""WITH {S.SENTENCES[1:]}, u AS (SELECT *, {S.content("text")} AS ts FROM s), v AS (SELECT * FROM u WHERE len(ts) >= 4 AND {S.word_count("text")} <= 70),
        c AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id),
        tf AS (SELECT doc_id, sent_idx, term, count(*) AS tf FROM (SELECT doc_id, sent_idx, unnest(ts) AS term FROM v) GROUP BY ALL),
        df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
        w AS (SELECT doc_id, sent_idx, term, tf * ln(1 + n / df) AS w FROM tf JOIN df USING (doc_id, term) JOIN c USING (doc_id)),
        z AS (SELECT doc_id, term, sum(w) AS c FROM w GROUP BY ALL), zz AS (SELECT doc_id, sum(c * c) AS cc FROM z GROUP BY ALL),
        p AS (SELECT doc_id, sent_idx, sum(w * c) AS dot, sum(w * w) AS ww FROM w JOIN z USING (doc_id, term) GROUP BY ALL)
        SELECT doc_id, sent_idx, round(dot / sqrt(ww * cc) + CASE sent_idx WHEN 0 THEN 0.08 WHEN 1 THEN 0.04 ELSE 0 END, 6) AS score FROM p JOIN zz USING (doc_id)""",
    "keyword_candidates": f"WITH {_KEYS} SELECT doc_id, term, weight, first_pos FROM c",
    "keywords_greedy": f"""WITH RECURSIVE {_KEYS},
        o AS (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first_pos) AS r FROM c),
        g(doc_id, r, kept) AS (
          SELECT doc_id, r, [term] FROM o WHERE r = 1
          UNION ALL
          SELECT g.doc_id, o.r, CASE WHEN (o.weight < 2 AND len(g.kept) >= 3) OR len(list_filter(g.kept, lambda y: contains(y, o.term) OR contains(o.term, y))) > 0
                 THEN g.kept ELSE list_append(g.kept, o.term) END
          FROM g JOIN o ON o.doc_id = g.doc_id AND o.r = g.r + 1 WHERE len(g.kept) < 8),
        b AS (SELECT doc_id, kept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) AS k FROM g) WHERE k = 1)
        SELECT doc_id, CAST(generate_subscripts(kept, 1) AS INTEGER) AS rank, unnest(kept) AS term FROM b""",
    "acronyms": r"""WITH m AS (SELECT doc_id, unnest(x) AS acronym, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\b[A-Z][A-Z0-9]{1,6}s?\b') AS x FROM documents)),
        f AS (SELECT doc_id, acronym, min(i) AS i FROM m WHERE NOT regexp_matches(acronym, '^[IVX]+$') GROUP BY ALL),
        r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, acronym FROM f)
        SELECT * FROM r WHERE n <= 30""",
    "blank_pages": rf"""WITH {_LINES} SELECT doc_id, CAST(sum(CASE WHEN len(regexp_extract_all(line, '\p{{L}}{{3,}}')) < 2 THEN 1 ELSE 0 END) AS BIGINT) AS blank, count(*) AS pages,
        sum(CASE WHEN len(regexp_extract_all(line, '\p{{L}}{{3,}}')) < 2 THEN 1 ELSE 0 END) * 2 > count(*) AS all_ocr FROM l GROUP BY doc_id""",
}
