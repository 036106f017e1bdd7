"""Answers, reviews, voice and résumés, scored by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(W.ascii_bounds(pattern)))


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question, answer``: an assistant's turn with the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = turns.withColumn("question", F.lag("text").over(order))
    return before.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"))


def relevance(question: Column, answer: Column) -> Column:
    """Share of the question's key stems (three count as all of them) in the answer; 70 where it has none."""
    noise = T.strings(W.QUESTION_NOISE)
    asked = F.array_distinct(F.transform(F.filter(T.content_terms(question), lambda t: (F.length(t) > 4) & ~F.array_contains(noise, t)), T.stem_prefix))
    own = F.array_distinct(F.transform(T.content_terms(answer), T.stem_prefix))
    hits = F.size(F.array_intersect(asked, own))
    return F.when(F.size(asked) == 0, 70.0).otherwise(F.least(F.lit(100.0), hits / F.least(F.size(asked), F.lit(3)) * 100))


def answer_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` with score, band and the four parts: length, structure, specificity, relevance."""
    text = T.strip(F.col("answer"))
    base = pairs.withColumns({"n": T.word_count(text), "situation": text.rlike(W.SITUATION), "action": text.rlike(W.ACTION), "result": text.rlike(W.RESULT)})
    n = F.col("n")
    length = F.when(n < 15, 10.0).when(n < 40, 45.0).when(n <= 260, 100.0).when(n <= 360, 75.0).otherwise(55.0)
    structure = (F.col("situation").cast("int") + F.col("action").cast("int") + F.col("result").cast("int")) / F.lit(3) * 100
    example = F.when(text.rlike(W.ascii_bounds(r"(?i)\bfor example|for instance|such as\b")), 20).otherwise(0)
    specific = F.least(F.lit(100.0), (count(text, r"\d+") * 20 + F.size(T.tech_terms(text)) * 20 + example).cast("double"))
    parts = base.withColumns({"length": length, "structure": structure, "specificity": specific, "relevance": relevance(F.col("question"), text)})
    filler = F.when((n > 0) & (count(text, W.FILLERS) / n * 100 > 3), 8).otherwise(0)
    we = F.when(count(text, r"(?i)\bwe\b") > count(text, r"\bI\b") + 1, 5).otherwise(0)
    raw = F.col("length") * 0.2 + F.col("structure") * 0.35 + F.col("specificity") * 0.2 + F.col("relevance") * 0.25 - filler - we
    score = T.js_round(F.round(F.when(n < 5, F.least(raw, F.lit(15.0))).otherwise(raw), 9))
    held = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    rounded = {c: T.js_round(F.round(c, 9)).cast("int") for c in ("length", "structure", "specificity", "relevance")}
    return parts.withColumn("score", held).withColumns(rounded).withColumn("band", T.band_for(F.col("score"))).select(*pairs.columns, "score", "band", *rounded)


def answer_review(answers: DataFrame) -> DataFrame:
    """``answers`` with words, situation, action, result, i_count, we_count, fillers and improvements."""
    text = T.strip(F.coalesce("answer", F.lit("")))
    seen = answers.withColumns({
        "words": T.word_count(text), "situation": text.rlike(W.SITUATION), "action": text.rlike(W.ACTION), "result": text.rlike(W.RESULT),
        "i_count": count(text, r"\bI\b"), "we_count": count(text, r"(?i)\bwe\b"), "fillers": count(text, W.REVIEW_FILLERS),
    })
    notes = F.array_compact(F.array(
        F.when(F.col("words") < 40, "short").when(F.col("words") > 320, "long"),
        F.when(~F.col("situation"), "situation"), F.when(~F.col("action"), "action"), F.when(~F.col("result"), "result"),
        F.when((F.col("we_count") >= 2) & (F.col("we_count") > F.col("i_count")), "we"), F.when(F.col("fillers") >= 3, "fillers"),
    ))
    return seen.withColumn("improvements", F.array_join(notes, ","))


def voice_report(stats: DataFrame) -> DataFrame:
    """``stats(duration_sec, speaking_sec, pauses, steadiness, transcript)`` with wpm, fillers, score, band; clips under 3 s give none."""
    text = F.coalesce("transcript", F.lit(""))
    n, fillers = T.word_count(text), count(text, W.FILLERS)
    own = stats.where("duration_sec >= 3").withColumns({"words": n, "fillers": fillers, "wpm": T.js_round(F.round(n / (F.greatest("speaking_sec", F.lit(1.0)) / 60), 9))})
    rate = F.coalesce(F.try_divide(F.col("fillers") * F.lit(100.0), F.col("words")), F.lit(0.0))
    per_minute = F.col("pauses") / F.greatest(F.col("duration_sec") / 60, F.lit(0.5))
    wpm = F.col("wpm")
    pace = F.when(wpm.between(115, 165), 100).when(wpm.between(95, 185), 75).when(F.col("words") > 0, 45).otherwise(0)
    fluency = F.when(rate <= 2, 100).when(rate <= 5, 70).otherwise(40)
    pausing = F.when(per_minute <= 3, 100).when(per_minute <= 6, 70).otherwise(45)
    base = pace * 0.35 + fluency * 0.25 + pausing * 0.2
    steady = T.js_round(F.col("steadiness") * 100)
    score = T.js_round(F.round(F.when(F.col("steadiness").isNull(), base / 0.8).otherwise(base + steady * 0.2), 9)).cast("int")
    return own.withColumn("score", score).withColumn("band", T.band_for(F.col("score")))


def interview_report(scored: DataFrame, by: str) -> DataFrame:
    """``by, answers, mean_score, blue, yellow, red``."""
    b = F.col("band")
    return scored.groupBy(by).agg(F.count("*").alias("answers"), T.js_round(F.avg("score")).cast("int").alias("mean_score"), F.count_if(b == "blue").alias("blue"), F.count_if(b == "yellow").alias("yellow"), F.count_if(b == "red").alias("red"))


# The headings of a résumé's sections.
RESUME_SECTIONS = {
    "summary": r"^(summary|profile|objective|about( me)?|professional summary|career (objective|summary))$",
    "experience": r"^((work|professional|relevant) )?(experience|employment( history)?|work history|internships?)$",
    "projects": r"^((personal|academic|key|selected|major) )?projects?$",
    "education": r"^(education|academic (background|details)|qualifications?)$",
    "skills": r"^((technical|core|key|professional) )?(skills|competencies|technologies|tech stack|tools( & technologies)?)$",
    "certifications": r"^(certifications?|courses|licen[cs]es( & certifications)?|training)$",
    "achievements": r"^(achievements|awards|accomplishments|honou?rs|awards & achievements)$",
}
BULLET = r"^\s*[-•*▪●◦‣○■□➢➤►✓]\s*"


def resume_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, section, line, bullet``: each line belongs to the last heading above it."""
    from ..sources.tables import lines

    flat = lines(docs).where(F.col("line").rlike(r"\S"))
    head = F.lower(T.strip(F.regexp_replace(T.strip(F.col("line")), r"[:|_\-–—]+$", "")))
    key = None
    for name, pattern in RESUME_SECTIONS.items():
        key = F.when(head.rlike(pattern), name) if key is None else key.when(head.rlike(pattern), name)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    known = flat.withColumn("key", F.when(F.size(F.split(head, r"\s+")) <= 5, key))
    placed = known.withColumn("section", F.coalesce(F.last("key", ignorenulls=True).over(order), F.lit("header"))).where("key IS NULL")
    return placed.select("doc_id", "line_no", "section", T.squash(F.regexp_replace("line", BULLET, "")).alias("line"), F.col("line").rlike(BULLET).alias("bullet"))


def resume_profile(docs: DataFrame) -> DataFrame:
    """``doc_id, name, email, skills, metrics, words, lines`` of each résumé."""
    rows = resume_lines(docs)
    name = (F.col("section") == "header") & (F.size(F.split("line", " ")) <= 4) & ~F.col("line").rlike(r"[@\d/:|]") & F.col("line").rlike(r"^\p{Lu}")
    metric = F.col("line").rlike(W.MEASURED) & (F.size(F.split("line", " ")) >= 5)
    bare = F.regexp_replace("line", r"^[^:]{2,30}:\s*", "")
    parts = F.filter(F.transform(F.split(bare, W.SKILL_SPLIT), T.strip), lambda x: F.length(x).between(2, 31) & (F.size(F.split(x, " ")) <= 4))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == "skills", F.struct("line_no", parts.alias("p"))))), lambda x: x["p"]))
    per = rows.groupBy("doc_id").agg(
        F.min_by(F.when(name, F.col("line")), F.when(name, F.col("line_no"))).alias("name"), listed.alias("listed"),
        F.transform(F.array_sort(F.collect_list(F.when(metric, F.struct("line_no", "line")))), lambda x: x["line"]).alias("metrics"), F.sum(T.word_count(F.col("line"))).alias("words"),
    )
    email = F.regexp_extract("text", W.EMAIL, 0)
    found = docs.select("doc_id", email.alias("email"), T.tech_terms(F.col("text")).alias("tech")).join(per, "doc_id")
    every = F.concat("listed", "tech")
    distinct = T.let(every, lambda a: F.slice(F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1), 1, 30))
    return found.select("doc_id", F.coalesce("name", F.lit("")).alias("name"), "email", distinct.alias("skills"), "metrics", "words")


def follow_up_focus(answers: DataFrame) -> DataFrame:
    """``answers`` with ``focus``: a skill, a figure or a challenge that an answer of twelve or more words names."""
    text = F.coalesce("answer", F.lit(""))
    metric = F.regexp_extract(text, W.FIGURE, 0)
    challenge = F.lower(F.regexp_extract(text, W.CHALLENGE, 1))
    team = F.when(text.rlike(W.TEAM), "team")
    some = lambda c: F.nullif(c, F.lit(""))
    focus = F.coalesce(F.get(T.tech_terms(text), F.lit(0)), some(F.substring(T.squash(metric), 1, 120)), some(challenge), team)
    return answers.withColumn("focus", F.when(T.word_count(text) >= 12, focus))
