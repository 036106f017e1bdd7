"""Registered queries of seeded order, grounding and figures, with their check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seeded
from ..functions import text as T
from ..operators import grounding
from ..sources.tables import spread, table


def seeded_numbers(spark, d):
    """Three numbers for each benchmark item, whose text is the seed."""
    seeds = table(spark, d, "benchmark").select("item_id", seeded.hashed(F.col("text")).alias("seed"))
    return seeds.select("item_id", "seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("item_id", "seed", "k", seeded.number(F.col("seed"), F.col("k")).alias("number"))


def grounded_questions(spark, d):
    """A question a document, whose answer is the document's first two words or an invented term."""
    docs = spread(table(spark, d, "documents"))
    words = F.split(T.squash(F.coalesce("text", F.lit(""))), " ")
    term = F.when(F.col("doc_id") % 3 != 0, F.array_join(F.slice(words, 1, 2), " ")).otherwise("Zzqx plorf")
    kind = F.element_at(T.strings(["blank", "term", "mcq", "tf"]), (F.col("doc_id") % 4 + 1).cast("int"))
    asked = docs.select(
        F.col("doc_id").alias("question_id"), "doc_id", kind.alias("type"), F.get(words, 0).alias("prompt"), F.array(term, F.lit("b?"), F.lit("c?"), F.lit("d?")).alias("options"), F.lit(0).alias("answer"),
        (F.col("doc_id") % 2 == 0).alias("truth"), F.lit(None).cast("array<struct<term:string,clue:string>>").alias("pairs"), (F.col("doc_id") % 5).cast("int").alias("page"), F.lit("").alias("explain"),
    )
    found = grounding.grounded(asked, docs)
    return found.select("question_id", "type", "prompt", F.array_join("options", "|").alias("options"), F.array_join(F.transform("answer", lambda x: x.cast("string")), "|").alias("answer"), "page")


def question_figures(spark, d):
    """Orders as questions and as figures of their customers; every seventh answer shows its own figure."""
    o = table(spark, d, "orders")
    own = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("see (image:f"), "o_orderkey", F.lit(")")))
    asked = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderkey").alias("shown_at"), ((F.col("o_orderkey") + 1) % 3).alias("page"), own.alias("answer"))
    figures = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("f"), "o_orderkey").alias("figure_id"), (F.col("o_orderkey") % 3).alias("page"), F.col("o_orderkey").alias("shown_at"))
    return grounding.figures_for(asked, figures)


QUERIES = {f.__name__: f for f in (seeded_numbers, grounded_questions, question_figures)}

_TURN = "CAST((CAST({a} AS HUGEINT) * {b}) % 4294967296 AS BIGINT)"
ORACLES = {
    "seeded_numbers": f"""WITH s AS (SELECT item_id, list_reduce(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS seed FROM benchmark),
        k AS (SELECT item_id, seed, CAST(k AS INTEGER) AS k, (CASE WHEN seed = 0 THEN 1 ELSE seed END + (k + 1) * CAST(1831565813 AS BIGINT)) % 4294967296 AS a FROM s, (SELECT unnest([0, 1, 2]) AS k)),
        t AS (SELECT *, {_TURN.format(a="xor(a, a >> 15)", b="(a | 1)")} AS t FROM k),
        u AS (SELECT *, xor(t, (t + {_TURN.format(a="xor(t, t >> 7)", b="(t | 61)")}) % 4294967296) AS u FROM t)
        SELECT item_id, seed, k, xor(u, u >> 14) / 4294967296 AS number FROM u""",
    "grounded_questions": r"""WITH w AS (SELECT *, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS ws, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS flat FROM documents),
        q AS (SELECT doc_id, flat, ['blank', 'term', 'mcq', 'tf'][doc_id % 4 + 1] AS type, ws[1] AS prompt, CASE WHEN doc_id % 3 <> 0 THEN array_to_string(ws[1:2], ' ') ELSE 'Zzqx plorf' END AS term, doc_id % 5 AS page,
              len(string_split(coalesce(text, ''), chr(12))) AS pages FROM w),
        p AS (SELECT *, regexp_extract_all(lower(term), '[\p{L}\p{N}.+#]{3,}') AS parts FROM q),
        g AS (SELECT *, contains(flat, lower(term)) OR (len(parts) > 0 AND len(list_filter(parts, lambda x: contains(flat, x))) >= 0.75 * len(parts)) AS held FROM p)
        SELECT doc_id AS question_id, type, CASE type WHEN 'tf' THEN 'True or false? “' || prompt || '”' WHEN 'blank' THEN 'Fill in the blank: “' || prompt || '”' WHEN 'term' THEN 'Which term is described here? “' || prompt || '”' ELSE prompt END AS prompt,
          CASE WHEN type = 'tf' THEN 'True|False' ELSE term || '|b?|c?|d?' END AS options, CASE WHEN type = 'tf' AND doc_id % 2 <> 0 THEN '1' ELSE '0' END AS answer, CAST(greatest(0, least(pages - 1, CASE WHEN page = 0 THEN 1 ELSE page END - 1)) AS INTEGER) AS page
        FROM g WHERE CASE WHEN type IN ('blank', 'term') THEN held ELSE prompt <> '' END""",
    "question_figures": """WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS question_id, 'f' || o_orderkey AS figure_id FROM orders WHERE o_orderkey % 7 = 0),
        p AS (SELECT o_custkey AS doc_id, o_orderkey AS question_id, (o_orderkey + 1) % 3 AS page, row_number() OVER (PARTITION BY o_custkey, (o_orderkey + 1) % 3 ORDER BY o_orderkey) - 1 AS nth FROM orders WHERE o_orderkey % 7 <> 0),
        f AS (SELECT o_custkey AS doc_id, 'f' || o_orderkey AS figure_id, o_orderkey % 3 AS page, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT doc_id, question_id, figure_id, true AS inline, CAST(0 AS INTEGER) AS place FROM i
        UNION ALL SELECT p.doc_id, question_id, figure_id, false, CAST(k % 2 AS INTEGER) FROM p JOIN f ON p.doc_id = f.doc_id AND p.page = f.page AND nth = k // 2""",
}
