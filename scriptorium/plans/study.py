"""Registered queries of study material, planning, scoring and signal, with their check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import planning, scoring, signal, study
from ..operators import retrieval as R
from ..sources.tables import lines, pages, spread, table
from . import sql as S
from .retrieval import _KEYS as R_SQL


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def definitions(spark, d):
    return study.definitions(_docs(spark, d))


def list_sentences(spark, d):
    return study.list_sentences(_docs(spark, d))


def acronym_expansions(spark, d):
    return study.expansions(_docs(spark, d))


def code_lines(spark, d):
    code = r"[{};]\s*$|^\s*(def |class |import |return |if \(|for \(|while \(|const |let |var |#include|int |void |SELECT |INSERT )"
    return lines(_docs(spark, d)).where(F.col("line").rlike(code)).select("doc_id", "line_no", "line")


def quiz_facts(spark, d):
    return study.facts(pages(_docs(spark, d))).select("doc_id", "text")


def fact_term_mentions(spark, d):
    terms = R.keywords(_docs(spark, d)).select("doc_id", "term")
    return study.term_mentions(study.facts(pages(_docs(spark, d))), terms)


def important_flags(spark, d):
    return study.important(_docs(spark, d).select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


def question_bank(spark, d):
    return study.question_bank(_docs(spark, d))


def flashcards(spark, d):
    return study.flashcards(study.question_bank(_docs(spark, d)))


def bank_counts(spark, d):
    b = study.question_bank(_docs(spark, d))
    return b.groupBy("type").agg(F.count("*").alias("questions"), F.count_if("important").alias("important"))


def notes_markdown(spark, d):
    return study.notes(_docs(spark, d))


def quiz_terms(spark, d):
    return study.quiz_terms(_docs(spark, d))


def quiz_sets(spark, d):
    return study.quiz_sets(_docs(spark, d))


def compared_definitions(spark, d):
    return study.compared_definitions(_docs(spark, d))


def head_pairs(spark, d):
    return study.head_pairs(_docs(spark, d))


def mention_counts(spark, d):
    terms = _docs(spark, d).select("doc_id", F.explode(F.array(F.lit("the"), F.lit("er"), F.col("lang"))).alias("term"))
    return study.mention_counts(_docs(spark, d), terms)


def term_cards(spark, d):
    return study.term_cards(_docs(spark, d))


def topic_split(spark, d):
    """Lines as pages of one topic a document, in parts for a target of 200 words."""
    from ..operators.folds import topic_fold

    w = _docs(spark, d).select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.word_count(x).cast("int")).alias("w"))
    x = w.select("doc_id", F.explode(F.arrays_zip(F.col("w").alias("w"), topic_fold(200)("w").alias("p"))).alias("x"))
    return x.groupBy("doc_id", F.col("x.p").alias("part")).agg(F.count("*").alias("pages"), F.sum("x.w").cast("long").alias("words"))


def _responses(spark, d):
    """Each order as a matching question: the right answer is its line numbers, the response their quantities modulo 7."""
    item = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 7 + 1).alias("q")))).alias("x"))
    return item.select("l_orderkey", F.transform("x", lambda x: x["l_linenumber"]).alias("answer"), F.transform("x", lambda x: x["q"]).alias("response"))


def grade_match(spark, d):
    return _responses(spark, d).select("l_orderkey", F.round(study.grade(F.lit("match"), F.col("answer"), F.col("response")), 6).alias("points"))


def quiz_breakdown(spark, d):
    graded = table(spark, d, "orders").join(_responses(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
    points = study.grade(F.lit("match"), F.col("answer"), F.col("response"))
    return graded.groupBy("o_orderpriority").agg(F.count("*").alias("questions"), F.round(F.sum(points), 4).alias("points"), T.js_round(F.sum(points) * 100 / F.count("*")).alias("percent"))


def topic_words(spark, d):
    return study.sectioned_topics(_docs(spark, d)).select("doc_id", "section", F.col("words").cast("long").alias("words"))


def plan_days(spark, d):
    topics = _docs(spark, d).select("source", "doc_id", F.lit("").alias("title"), (T.word_count(F.col("text")) + 1).cast("long").alias("words"))
    return planning.plan(topics, "source", "doc_id", 7).select("source", "doc_id", "day", "minutes")


def multi_plan(spark, d):
    """A plan a source over all of its documents; twelve lines are a page."""
    docs = _docs(spark, d)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cut = T.let(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 12).cast("int")), lambda k: F.array_join(F.slice(x, k * 12 + 1, F.lit(12)), "\n")))
    as_pages = docs.select("doc_id", F.posexplode(cut).alias("page", "text"))
    members = docs.select(F.col("source").alias("plan"), F.col("doc_id").alias("position"), "doc_id")
    found = planning.multi_plan(as_pages, members, 7)
    return found.select(F.col("plan").alias("source"), "doc_id", "topic", "part", F.col("start").alias("first_page"), F.col("end").alias("last_page"), "words", "day", "minutes")


def plan_totals(spark, d):
    topics = _docs(spark, d).select("source", "doc_id", F.lit("").alias("title"), (T.word_count(F.col("text")) + 1).cast("long").alias("words"))
    return planning.totals(planning.plan(topics, "source", "doc_id", 7), "source")


def answer_scores(spark, d):
    pairs = scoring.question_answer_pairs(table(spark, d, "conversations"))
    return scoring.answer_scores(pairs).drop("question", "answer")


def answer_review(spark, d):
    pairs = scoring.question_answer_pairs(table(spark, d, "conversations"))
    return scoring.answer_review(pairs).drop("question", "answer")


def interview_report(spark, d):
    pairs = scoring.question_answer_pairs(table(spark, d, "conversations"))
    return scoring.interview_report(scoring.answer_scores(pairs), "conv_id")


def tech_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.tech_terms(F.col("text")), "|").alias("terms"))


def voice_report(spark, d):
    turns = table(spark, d, "conversations")
    n = T.word_count(F.col("text"))
    stats = turns.select(
        "conv_id", "turn", (n / F.lit(2.0)).alias("duration_sec"), (n / F.lit(2.5)).alias("speaking_sec"), (F.col("turn") % 4).alias("pauses"),
        F.when(F.col("turn") % 2 == 0, 0.5).alias("steadiness"), F.col("text").alias("transcript"),
    )
    return scoring.voice_report(stats).select("conv_id", "turn", "words", "fillers", "wpm", "score", "band")


def follow_ups(spark, d):
    pairs = scoring.question_answer_pairs(table(spark, d, "conversations"))
    return scoring.follow_up_focus(pairs).select("conv_id", "turn", "focus")


def resume_profiles(spark, d):
    return scoring.resume_profile(_docs(spark, d))


def transcripts_clean(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_transcript(F.col("text")).alias("clean"))


def _clips(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"))


def signal_rms(spark, d):
    return signal.frame_energy(_clips(spark, d), 8).select("clip_id", "frame", F.round("rms", 6).alias("rms"))


def signal_threshold(spark, d):
    return signal.thresholds(signal.frame_energy(_clips(spark, d), 8)).select("clip_id", F.col("frames").cast("long").alias("frames"), F.round("threshold", 6).alias("threshold"))


def signal_resample(spark, d):
    return signal.resample(_clips(spark, d), 48000, 16000).select("clip_id", "idx", F.round("x", 6).alias("x"))


def signal_speech(spark, d):
    return signal.speech(signal.frame_energy(_clips(spark, d), 8))


def voice_stats(spark, d):
    loudness = signal.samples(_clips(spark, d)).select("clip_id", "idx", F.abs(F.col("x").cast("double")).alias("rms"))
    return signal.voice_stats(loudness)


def speech_timing(spark, d):
    marks = table(spark, d, "events").select(F.col("user_id").alias("session"), "ts")
    return signal.speech_timing(marks, 300)


QUERIES = {f.__name__: f for f in (
    definitions, list_sentences, acronym_expansions, code_lines, quiz_facts, fact_term_mentions, important_flags, question_bank, flashcards, bank_counts, notes_markdown, quiz_terms, quiz_sets, compared_definitions, head_pairs, mention_counts, term_cards, topic_split,
    grade_match, quiz_breakdown, topic_words, plan_days, multi_plan, plan_totals, answer_scores, answer_review, interview_report, tech_terms, voice_report, follow_ups, resume_profiles, transcripts_clean,
    signal_rms, signal_threshold, signal_resample, signal_speech, voice_stats, speech_timing,
)}


def _re(pattern: str) -> str:
    return pattern.replace(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\b").replace("'", "''")


_ACTION_VERB = _re(W.ACTION).replace(r"(?!am\b|was\b|think\b|feel\b|guess\b|believe\b|hope\b|want\b|would\b|will\b)", "")
_FACTS = rf"""
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
        regexp_split_to_array(coalesce(text, ''), '\n+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS x FROM documents)),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l),
m AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND NOT regexp_matches(prev, '[.!?:]$') AND regexp_matches(line, '^[\p{{Ll}}(]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),
pa AS (SELECT doc_id, g, string_agg(line, ' ' ORDER BY i) AS text FROM m GROUP BY doc_id, g),
se AS (SELECT doc_id, g, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, g, {S.sentences("text")} AS x FROM pa)),
cl AS (SELECT doc_id, g, i, trim(regexp_replace(s, '^[\d.)\s]+(\p{{L}})', '\1')) AS text FROM se),
go AS (SELECT * FROM cl WHERE {S.word_count("text")} BETWEEN 5 AND 70 AND len(regexp_extract_all(text, '\p{{L}}')) >= length(text) * 0.55::DOUBLE),
fa AS (SELECT doc_id, arg_min(text, g * 100000 + i) AS text FROM go GROUP BY doc_id, lower(text))"""

_PAIRS = """
pr AS (SELECT conv_id, turn, role, coalesce(text, '') AS answer, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS question FROM conversations),
qa AS (SELECT conv_id, turn, question, answer, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS t FROM pr WHERE role = 'assistant')"""

_SIGNS = rf"""regexp_matches(t, '{_re(W.SITUATION)}') AS situation, regexp_matches(t, '{_ACTION_VERB}') AS action, regexp_matches(t, '{_re(W.RESULT)}') AS result"""
_NOISE = S.texts(W.QUESTION_NOISE)
_SKILL = rf"regexp_extract_all(t, '(?i)(?:^|[^\p{{L}}\p{{N}}])({W.SKILLS})(?:$|[^\p{{L}}\p{{N}}+#])', 1)"

_RESPONSES = """
x AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber = CAST(l_quantity AS INTEGER) % 7 + 1 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY l_orderkey)"""

def _dealt(keys: str) -> str:
    """Topics ``t(source, <keys>, words, i)`` dealt onto six study days of two hours."""
    own = ", ".join(f"t.{k}" for k in keys.split(", "))
    return f"""
tt AS (SELECT source, sum(words) AS total, count(*) AS n, least(6, count(*)) AS days FROM t GROUP BY source),
f(source, i, day, load) AS (
  SELECT source, i, 0, CAST(words AS DOUBLE) FROM t WHERE i = 1
  UNION ALL
  SELECT f.source, t.i,
    CASE WHEN days - f.day - 1 > 0 AND (f.load + t.words / 2 > total / days OR n - t.i + 1 = days - f.day - 1) THEN f.day + 1 ELSE f.day END,
    CASE WHEN days - f.day - 1 > 0 AND (f.load + t.words / 2 > total / days OR n - t.i + 1 = days - f.day - 1) THEN 0 ELSE f.load END + t.words
  FROM f JOIN t ON t.source = f.source AND t.i = f.i + 1 JOIN tt ON tt.source = f.source),
dl AS (SELECT t.source, {own}, t.words, f.day + 1 AS day, sum(t.words) OVER (PARTITION BY t.source, f.day) AS load FROM t JOIN f USING (source, i)),
hv AS (SELECT *, max(load) OVER (PARTITION BY source) AS heaviest FROM dl),
mi AS (SELECT *, greatest(5, floor(105.0 * words / heaviest + 0.5)) AS m FROM hv),
mm AS (SELECT *, sum(m) OVER (PARTITION BY source, day) AS total FROM mi),
pl AS (SELECT source, {keys}, words, day, CAST(CASE WHEN total > 105 THEN greatest(5, floor(m * 105 / total)) ELSE m END AS BIGINT) AS minutes FROM mm)"""


_DAYS = f"""
t AS (SELECT source, doc_id, {S.word_count("text")} + 1 AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),{_dealt("doc_id")}"""

_UNITS = f"""
li AS (SELECT source, doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS no FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
nb AS (SELECT *, no // 12 AS page, {S.heading("line")} AS head FROM li WHERE regexp_matches(line, '\\S')),
le AS (SELECT *, bool_and(head) OVER (PARTITION BY doc_id, page ORDER BY no) AS lead FROM nb),
pg AS (SELECT doc_id, page, bool_or(lead) AS opens, sum(CASE WHEN lead THEN 0 ELSE {S.word_count("line")} END) AS words, bool_or(NOT lead) AS held FROM le GROUP BY ALL),
ap AS (SELECT DISTINCT source, doc_id, no // 12 AS page FROM li),
tg AS (SELECT ap.source, ap.doc_id, ap.page, coalesce(words, 0) + 1 AS words, coalesce(opens, false) AS opens, coalesce(held, false) AS held, bool_or(pg.page IS NOT NULL) OVER (PARTITION BY ap.doc_id) AS lined
       FROM ap LEFT JOIN pg ON ap.doc_id = pg.doc_id AND ap.page = pg.page),
tn AS (SELECT *, CASE WHEN lined THEN sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY page) ELSE page END AS topic FROM tg),
tp AS (SELECT source, doc_id, topic, list(page ORDER BY page) FILTER (held OR NOT lined) AS pp, list(words ORDER BY page) FILTER (held OR NOT lined) AS w, min(page) FILTER (opens) AS opened FROM tn GROUP BY ALL),
ts AS (SELECT tp.*, target FROM tp JOIN (SELECT source, sum(list_sum(w)) / 6 AS target FROM tp GROUP BY source) USING (source) WHERE len(pp) > 0),
u(doc_id, topic, i, p, load) AS (
  SELECT doc_id, topic, 1, 0, w[1] FROM ts
  UNION ALL
  SELECT u.doc_id, u.topic, u.i + 1, CASE WHEN u.load >= ts.target * 0.8 THEN u.p + 1 ELSE u.p END, CASE WHEN u.load >= ts.target * 0.8 THEN 0 ELSE u.load END + ts.w[u.i + 1]
  FROM u JOIN ts ON u.doc_id = ts.doc_id AND u.topic = ts.topic WHERE u.i < len(ts.w)),
ul AS (SELECT doc_id, topic, arg_max(p, i) AS p, arg_max(load, i) AS load FROM u GROUP BY ALL),
uq AS (SELECT ts.source, doc_id, topic, ts.pp[u.i] AS page, ts.w[u.i] AS words, opened,
         CASE WHEN list_sum(ts.w) <= ts.target * 1.25 OR len(ts.w) < 2 THEN 0 WHEN ul.p > 0 AND ul.load < ts.target * 0.3 AND u.p = ul.p THEN u.p - 1 ELSE u.p END AS part
       FROM u JOIN ts USING (doc_id, topic) JOIN ul USING (doc_id, topic)),
un AS (SELECT source, doc_id, topic, part, CASE WHEN part = 0 THEN least(coalesce(min(opened), min(page)), min(page)) ELSE min(page) END AS first_page, max(page) AS last_page, sum(words) AS words FROM uq GROUP BY source, doc_id, topic, part),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, topic, part) AS i FROM un),{_dealt("doc_id, topic, part, first_page, last_page")}"""

_FRAMES = """
x AS (SELECT vec_id AS clip_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT clip_id, CAST(i // 8 AS INTEGER) AS frame, sqrt(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS rms FROM x GROUP BY ALL)"""

ORACLES = {
    "definitions": rf"""WITH {S.SENTENCES}, m AS (SELECT doc_id, sent_idx, lower(regexp_extract(text, '{_re(W.SUBJECT)}', 1)) AS subject FROM s)
        SELECT * FROM m WHERE length(subject) > 3 AND NOT regexp_matches(subject, '{_re(W.WEAK_SUBJECT)}')""",
    "list_sentences": rf"""WITH {S.SENTENCES}, m AS (SELECT doc_id, sent_idx, lower(regexp_extract(text, '{_re(W.LIST)}', 1)) AS subject, regexp_extract(text, '{_re(W.LIST)}', 2) AS rest FROM s),
        i AS (SELECT *, CAST(len(list_filter(list_transform(regexp_split_to_array(regexp_replace(rest, '[.;]\s*$', ''), ',\s*(?:and\s+|or\s+)?|\s+and\s+'), lambda x: trim(x)), lambda x: length(x) > 1)) AS BIGINT) AS items FROM m WHERE subject <> '')
        SELECT doc_id, sent_idx, subject, items FROM i WHERE items BETWEEN 3 AND 8 AND contains(rest, ',')""",
    "compared_definitions": rf"""WITH {S.SENTENCES}, m AS (SELECT doc_id, sent_idx, text, lower(regexp_extract(text, '{_re(W.SUBJECT)}', 1)) AS subject FROM s),
        f AS (SELECT doc_id, sent_idx, subject, list_distinct(list_transform({S.content("text")}, lambda w: left(w, 5))) AS st FROM m WHERE length(subject) > 3 AND NOT regexp_matches(subject, '{_re(W.WEAK_SUBJECT)}')),
        p AS (SELECT *, lead(subject) OVER w AS other, lead(st) OVER w AS theirs FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx))
        SELECT doc_id, sent_idx, subject, other FROM p WHERE other <> subject AND len(list_intersect(st, theirs)) >= 2""",
    "head_pairs": f"""WITH {R_SQL}, h AS (SELECT doc_id, term, first_pos, string_split(term, ' ')[-1] AS head FROM c WHERE contains(term, ' ') AND weight >= 3),
        p AS (SELECT doc_id, head, term, lead(term) OVER (PARTITION BY doc_id, head ORDER BY first_pos) AS other FROM h) SELECT * FROM p WHERE other IS NOT NULL""",
    "mention_counts": """WITH t AS (SELECT doc_id, text, unnest(['the', 'er', lang]) AS term FROM documents)
        SELECT doc_id, term, CAST((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS BIGINT) AS n FROM t WHERE term <> ''""",
    "topic_split": """WITH RECURSIVE n AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_extract_all(x, '\\S+'))) AS w FROM documents),
        f(doc_id, i, p, load) AS (
          SELECT doc_id, 1, 0, w[1] FROM n
          UNION ALL
          SELECT f.doc_id, f.i + 1, CASE WHEN f.load >= 160 THEN f.p + 1 ELSE f.p END, CASE WHEN f.load >= 160 THEN 0 ELSE f.load END + n.w[f.i + 1] FROM f JOIN n ON f.doc_id = n.doc_id WHERE f.i < len(n.w)),
        l AS (SELECT doc_id, arg_max(p, i) AS p, arg_max(load, i) AS load FROM f GROUP BY doc_id),
        q AS (SELECT f.doc_id, f.i, n.w[f.i] AS w, CASE WHEN list_sum(n.w) <= 250 OR len(n.w) < 2 THEN 0 WHEN l.p > 0 AND l.load > 0 AND l.load < 60 AND f.p = l.p THEN f.p - 1 ELSE f.p END AS p
              FROM f JOIN n USING (doc_id) JOIN l USING (doc_id))
        SELECT doc_id, CAST(p AS INTEGER) AS part, count(*) AS pages, CAST(sum(w) AS BIGINT) AS words FROM q GROUP BY doc_id, p""",
    "code_lines": r"""WITH l AS (SELECT doc_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
        SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, '[{};]\s*$|^\s*(def |class |import |return |if \(|for \(|while \(|const |let |var |#include|int |void |SELECT |INSERT )')""",
    "quiz_facts": f"WITH {_FACTS} SELECT doc_id, text FROM fa",
    "important_flags": """SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.4 + 0.5)) AS important FROM documents""",
    "grade_match": f"WITH {_RESPONSES} SELECT l_orderkey, round(ok / n, 6) AS points FROM x",
    "quiz_breakdown": f"WITH {_RESPONSES} SELECT o_orderpriority, count(*) AS questions, round(sum(ok / n), 4) AS points, CAST(floor(sum(ok / n) * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM orders JOIN x ON o_orderkey = l_orderkey GROUP BY ALL",
    "topic_words": f"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
        h AS (SELECT *, CASE WHEN {S.heading("line")} THEN 1 ELSE 0 END AS head FROM l WHERE regexp_matches(line, '\\S')),
        k AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
        SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(sum(CASE WHEN head = 0 THEN {S.word_count("line")} ELSE 0 END) + 1 AS BIGINT) AS words FROM k GROUP BY ALL""",
    "multi_plan": f"""WITH RECURSIVE {_UNITS} SELECT source, doc_id, CAST(topic AS BIGINT) AS topic, CAST(part AS INTEGER) AS part, CAST(first_page AS INTEGER) AS first_page, CAST(last_page AS INTEGER) AS last_page,
        CAST(words AS BIGINT) AS words, CAST(day AS INTEGER) AS day, minutes FROM pl""",
    "plan_days": f"WITH RECURSIVE {_DAYS} SELECT source, doc_id, CAST(day AS INTEGER) AS day, minutes FROM pl",
    "plan_totals": f"""WITH RECURSIVE {_DAYS}, d AS (SELECT source, day, sum(words) AS w, sum(minutes) AS m FROM pl GROUP BY ALL)
        SELECT source, count(*) AS days, CAST(sum(w) AS BIGINT) AS words, CAST(sum(m) AS BIGINT) AS minutes, CAST(max(w) AS BIGINT) AS heaviest_day_words FROM d GROUP BY source""",
    "answer_scores": rf"""WITH {_PAIRS},
        b AS (SELECT *, {S.word_count("t")} AS n, {_SIGNS}, list_distinct(list_transform(list_filter({S.content("question")}, lambda w: length(w) > 4 AND NOT list_contains({_NOISE}, w)), lambda w: left(w, 5))) AS qt,
              list_distinct(list_transform({S.content("t")}, lambda w: left(w, 5))) AS own, len(regexp_extract_all(t, '\d+')) AS numbers, len(list_distinct(list_transform({_SKILL}, lambda w: lower(w)))) AS tech,
              regexp_matches(t, '(?i)\bfor example|for instance|such as\b') AS example, len(regexp_extract_all(t, '{_re(W.FILLERS)}')) AS fillers, len(regexp_extract_all(t, '(?i)\bwe\b')) AS we, len(regexp_extract_all(t, '\bI\b')) AS i FROM qa),
        p AS (SELECT *, CASE WHEN n < 15 THEN 10.0 WHEN n < 40 THEN 45.0 WHEN n <= 260 THEN 100.0 WHEN n <= 360 THEN 75.0 ELSE 55.0 END AS l,
              (situation::INT + action::INT + result::INT) / 3 * 100 AS st, least(100.0, numbers * 20 + tech * 20 + CASE WHEN example THEN 20 ELSE 0 END) AS sp,
              CASE WHEN len(qt) = 0 THEN 70.0 ELSE least(100.0, len(list_intersect(qt, own)) / least(len(qt), 3) * 100) END AS re FROM b),
        w AS (SELECT *, l * 0.2 + st * 0.35 + sp * 0.2 + re * 0.25 - CASE WHEN n > 0 AND fillers / n * 100 > 3 THEN 8 ELSE 0 END - CASE WHEN we > i + 1 THEN 5 ELSE 0 END AS raw FROM p),
        z AS (SELECT *, CAST(greatest(0, least(100, floor(round(CASE WHEN n < 5 THEN least(raw, 15.0) ELSE raw END, 9) + 0.5))) AS INTEGER) AS score FROM w)
        SELECT conv_id, turn, score, CASE WHEN score >= 75 THEN 'blue' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS band, CAST(floor(l + 0.5) AS INTEGER) AS length,
               CAST(floor(round(st, 9) + 0.5) AS INTEGER) AS structure, CAST(floor(sp + 0.5) AS INTEGER) AS specificity, CAST(floor(round(re, 9) + 0.5) AS INTEGER) AS relevance FROM z""",
    "answer_review": rf"""WITH {_PAIRS}, b AS (SELECT conv_id, turn, CAST({S.word_count("t")} AS INTEGER) AS words, {_SIGNS}, CAST(len(regexp_extract_all(t, '\bI\b')) AS INTEGER) AS i_count, CAST(len(regexp_extract_all(t, '(?i)\bwe\b')) AS INTEGER) AS we_count,
              CAST(len(regexp_extract_all(t, '{_re(W.REVIEW_FILLERS)}')) AS INTEGER) AS fillers FROM qa)
        SELECT *, array_to_string(list_filter([CASE WHEN words < 40 THEN 'short' WHEN words > 320 THEN 'long' END, CASE WHEN NOT situation THEN 'situation' END, CASE WHEN NOT action THEN 'action' END,
               CASE WHEN NOT result THEN 'result' END, CASE WHEN we_count >= 2 AND we_count > i_count THEN 'we' END, CASE WHEN fillers >= 3 THEN 'fillers' END], lambda x: x IS NOT NULL), ',') AS improvements FROM b""",
    "voice_report": rf"""WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS t, turn % 4 AS pauses, CASE WHEN turn % 2 = 0 THEN 0.5 END AS st FROM conversations),
        c AS (SELECT *, CAST({S.word_count("t")} AS INTEGER) AS words, CAST(len(regexp_extract_all(t, '{_re(W.FILLERS)}')) AS INTEGER) AS fillers FROM b),
        e AS (SELECT *, words / 2.0 AS du, CAST(floor(round(words / (greatest(words / 2.5, 1.0) / 60), 9) + 0.5) AS BIGINT) AS wpm, CASE WHEN words = 0 THEN 0 ELSE fillers * 100.0 / words END AS rate FROM c WHERE words / 2.0 >= 3),
        f AS (SELECT *, CASE WHEN wpm BETWEEN 115 AND 165 THEN 100 WHEN wpm BETWEEN 95 AND 185 THEN 75 WHEN words > 0 THEN 45 ELSE 0 END * 0.35::DOUBLE + CASE WHEN rate <= 2 THEN 100 WHEN rate <= 5 THEN 70 ELSE 40 END * 0.25::DOUBLE
              + CASE WHEN pauses / greatest(du / 60, 0.5) <= 3 THEN 100 WHEN pauses / greatest(du / 60, 0.5) <= 6 THEN 70 ELSE 45 END * 0.2::DOUBLE AS base FROM e),
        g AS (SELECT *, CAST(floor(round(CASE WHEN st IS NULL THEN base / 0.8::DOUBLE ELSE base + floor(st * 100 + 0.5) * 0.2::DOUBLE END, 9) + 0.5) AS INTEGER) AS score FROM f)
        SELECT conv_id, turn, words, fillers, wpm, score, CASE WHEN score >= 75 THEN 'blue' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS band FROM g""",
    "signal_rms": f"WITH {_FRAMES} SELECT clip_id, frame, round(rms, 6) AS rms FROM f",
    "signal_threshold": f"""WITH {_FRAMES}, g AS (SELECT clip_id, list_sort(list(rms)) AS e FROM f GROUP BY clip_id)
        SELECT clip_id, CAST(len(e) AS BIGINT) AS frames, round(least(greatest(0.008, 3 * e[CAST(floor(len(e) * 0.1::DOUBLE) AS INTEGER) + 1]), greatest(e[CAST(floor(len(e) * 0.9::DOUBLE) AS INTEGER) + 1] * 0.5, 0.008)), 6) AS threshold FROM g""",
    "signal_resample": """WITH x AS (SELECT vec_id AS clip_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings)
        SELECT clip_id, CAST(i // 3 AS INTEGER) AS idx, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM x WHERE i // 3 < n // 3 GROUP BY ALL""",
    "speech_timing": """WITH g AS (SELECT user_id AS session, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000000.0, 1.0) AS gap FROM events)
        SELECT session, count(*) AS marks, CAST(sum(CASE WHEN gap >= 300 THEN 1 ELSE 0 END) AS BIGINT) AS pauses, round(sum(CASE WHEN gap >= 300 THEN 1.0 ELSE gap END), 3) AS speaking_sec,
               floor(coalesce(max(CASE WHEN gap >= 300 THEN gap END), 0) * 10 + 0.5) / 10 AS longest_pause_sec FROM g GROUP BY session""",
}
