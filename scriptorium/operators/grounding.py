"""Model-written questions held against their document: what it doesn't speak of is refused.

The questions of a document meet its text in one join, some hundred at a time, and are tested
within that row: the text is lowered and its white space collapsed once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions import text as T

TYPES = ("mcq", "tf", "blank", "term", "match", "correct")
#: Questions that one copy of a document's text is joined with.
TOGETHER = 200


def flat(text: Column) -> Column:
    return T.squash(F.lower(F.coalesce(text, F.lit(""))))


def in_text(term: Column, whole: Column) -> Column:
    """Whether ``whole`` (``flat``) holds the term, or it without what stands in brackets, or three
    quarters of its words of three characters or more."""
    low = T.squash(F.lower(F.coalesce(term, F.lit(""))))
    core = T.squash(F.regexp_replace(low, r"\([^)]*\)", ""))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}.+#]{3,}"), 0)
    share = T.let(words, lambda ws: (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: F.contains(whole, w))) >= F.size(ws) * 0.75))
    return (low != "") & (F.contains(whole, low) | ((F.length(core) >= 2) & F.contains(whole, core)) | share)


def grounded(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """``question_id, doc_id, type, prompt, options, answer (array), terms, page, explain`` of the
    questions that stand.

    ``questions(question_id, doc_id, type, prompt, options, answer, truth, pairs, page, explain)``: a known
    type; for ``tf`` a ``truth`` and a prompt; for ``match`` at least three (four count) ``pairs(term, clue)`` with all
    terms in the document; else four different options and an answer from 0 to 3, which for
    ``blank`` and ``term`` is in the document. Questions on unknown documents go. Page n is counted from 1."""
    q = questions.where(F.col("type").isin(*TYPES))
    many = q.groupBy("doc_id").agg(F.ceil(F.count("*") / TOGETHER).alias("salts"))
    keyed = q.join(many, "doc_id").withColumn("salt", F.pmod(F.xxhash64("question_id"), "salts"))
    columns = ["question_id", "type", "prompt", "options", "answer", "truth", "pairs", "page", "explain"]
    listed = keyed.groupBy("doc_id", "salt").agg(F.collect_list(F.struct(*columns)).alias("qs"))
    pages = F.size(F.split(F.coalesce("text", F.lit("")), "\f"))
    own = listed.join(docs.select("doc_id", flat(F.col("text")).alias("whole"), pages.alias("pages")), "doc_id")

    none = F.array().cast(questions.schema["pairs"].dataType)
    full = lambda p: (F.coalesce(p["term"], F.lit("")) != "") & (F.coalesce(p["clue"], F.lit("")) != "")
    four = lambda q: F.slice(F.filter(F.coalesce(q["pairs"], none), full), 1, 4)

    def stands(q: Column) -> Column:
        said = F.coalesce(q["prompt"], F.lit("")) != ""
        matched = T.let(four(q), lambda ps: (F.size(ps) >= 3) & F.forall(ps, lambda p: in_text(p["term"], F.col("whole"))))
        chosen = (F.size(q["options"]) == 4) & (F.size(F.array_distinct(q["options"])) == 4) & q["answer"].between(0, 3)
        named = ~q["type"].isin("blank", "term") | in_text(F.get(q["options"], q["answer"].cast("int")), F.col("whole"))
        return F.coalesce(F.when(q["type"] == "tf", q["truth"].isNotNull() & said).when(q["type"] == "match", matched).otherwise(chosen & named & (said | (q["type"] != "mcq"))), F.lit(False))

    kept = own.select("doc_id", "pages", F.explode(F.filter("qs", stands)).alias("q")).select("doc_id", "pages", "q.*").withColumn("pairs", four({c: F.col(c) for c in columns}))
    terms = F.transform("pairs", lambda p: p["term"])
    order = seeded.shuffled(F.transform("pairs", lambda p, i: i), seeded.hashed(F.array_join(terms, "|")))
    is_match, is_tf = F.col("type") == "match", F.col("type") == "tf"
    clues = F.transform("order", lambda i: F.get("pairs", i)["clue"])
    place = F.transform(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: (F.array_position("order", i) - 1).cast("int"))
    said = F.coalesce("prompt", F.lit(""))
    quoted = lambda lead, text: F.concat(F.lit(f"{lead} “"), text, F.lit("”"))
    prompt = (  # fixed texts
        F.when(is_tf, quoted("True or false?", said)).when(is_match, "Match each term with its description.").when(F.col("type") == "correct", "Which statement is correct according to the document?")
        .when(F.col("type") == "blank", quoted("Fill in the blank:", F.regexp_replace(said, r"(?i)^Fill in the blank:\s*", ""))).when(F.col("type") == "term", quoted("Which term is described here?", said)).otherwise(said)
    )
    page = F.greatest(F.lit(0), F.least(F.col("pages") - 1, F.coalesce(F.nullif(F.col("page"), F.lit(0)), F.lit(1)) - 1))
    return kept.withColumn("order", order).select(
        "question_id", "doc_id", "type", prompt.alias("prompt"),
        F.when(is_tf, F.array(F.lit("True"), F.lit("False"))).when(is_match, clues).otherwise(F.col("options")).alias("options"),
        F.when(is_tf, F.array(F.when(F.col("truth"), 0).otherwise(1))).when(is_match, place).otherwise(F.array(F.col("answer").cast("int"))).alias("answer"),
        F.when(is_match, terms).alias("terms"), page.cast("int").alias("page"), F.coalesce("explain", F.lit("")).alias("explain"),
    )


def figures_for(questions: DataFrame, figures: DataFrame) -> DataFrame:
    """``doc_id, question_id, figure_id, inline, place`` for ``questions(doc_id, question_id, shown_at, page, answer)`` and
    ``figures(doc_id, figure_id, page, shown_at)``: the figures that an answer shows itself; for the other
    questions of a page, in the order shown, two each of the page's figures that no answer shows.

    Who gets which figure follows from two ranks within the page, so that no question waits for another."""
    ids = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\(image:([^)\s]+)\)"), 1)
    asked = questions.withColumn("ids", ids)
    inline = asked.select("doc_id", "question_id", F.posexplode("ids").alias("place", "figure_id"))
    per = Window.partitionBy("doc_id", "page")
    plain = asked.where(F.size("ids") == 0).withColumn("nth", F.row_number().over(per.orderBy("shown_at", "question_id")) - 1)
    held = inline.select("doc_id", "figure_id").distinct()
    free = figures.join(held, ["doc_id", "figure_id"], "left_anti").withColumn("k", F.row_number().over(per.orderBy("shown_at", "figure_id")) - 1)
    lent = plain.join(free.select("doc_id", "page", "figure_id", F.floor(F.col("k") / 2).cast("int").alias("nth"), (F.col("k") % 2).alias("place")), ["doc_id", "page", "nth"])
    shape = lambda df, own: df.select("doc_id", "question_id", "figure_id", F.lit(own).alias("inline"), F.col("place").cast("int").alias("place"))
    return shape(inline, True).unionByName(shape(lent, False))
