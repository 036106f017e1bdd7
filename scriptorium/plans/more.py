"""Registered queries of streams, structure, models and change logs, with their check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import models
from ..operators import activity, mutations, planning, study
from ..sources.readers import pages_needing_ocr
from ..sources.scratch import shared
from ..sources.tables import lines, pages, spread, table
from ..streaming import live


def _event_stream(spark, d):
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(spark, d):
    """Sessions of a stream over what is there; equal to those of the table."""
    folder = shared(spark, "sessions")
    return live.whole(_event_stream(spark, d), live.heartbeat_sessions, folder).select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


def stream_activity(spark, d):
    folder = shared(spark, "activity")
    return live.whole(_event_stream(spark, d), live.activity, folder).select(F.unix_micros("started").alias("started"), "event_type", "events")


def page_structure(spark, d):
    return M.structure(pages(table(spark, d, "documents"))).groupBy("doc_id", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def bank_blocks(spark, d):
    return M.markdown_blocks(study.bank_markdown(study.question_bank(table(spark, d, "documents")))).groupBy("doc_id", "type").agg(F.count("*").alias("blocks"))


def ocr_pages(spark, d):
    as_pages = lines(table(spark, d, "documents")).select("doc_id", F.col("line_no").alias("page"), F.col("line").alias("text"), (F.col("line_no") % 2 == 0).alias("has_picture"))
    return pages_needing_ocr(as_pages)


def embedded_questions(spark, d):
    return models.embedded(table(spark, d, "benchmark"), models.Offline()).select("item_id", F.size("embedding").alias("dim"), "error")


def change_log(spark, d):
    """Each line of an order changes its status and part; a returned line deletes it, a later one may set it anew."""
    l = table(spark, d, "lineitem")
    op = F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "set").otherwise("update")
    seq = F.col("l_linenumber") * 100_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    change = F.struct(op.alias("op"), F.col("l_linestatus").alias("status"), F.col("l_partkey").cast("string").alias("part"))
    log = l.groupBy(F.col("l_orderkey").alias("id"), seq.alias("seq")).agg(F.max(change).alias("c"))
    patch = F.create_map(F.lit("status"), F.col("c.status"), F.lit("part"), F.col("c.part"))
    folded = mutations.folded(log.select("seq", "id", "c.op", patch.alias("patch")))
    return folded.select("id", F.col("fields")["status"].alias("status"), F.col("fields")["part"].alias("part"))


def activity_counters(spark, d):
    e = table(spark, d, "events")
    return mutations.counters(e.select(F.col("user_id").alias("uid"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("delta"), F.col("ts").alias("at")))


def sentence_cards(spark, d):
    return study.sentence_cards(pages(spread(table(spark, d, "documents"))))


def plan_progress(spark, d):
    topics = table(spark, d, "documents").select("source", "doc_id", F.lit("").alias("title"), F.col("n_chars").cast("long").alias("words"))
    return planning.progress(planning.plan(topics, "source", "doc_id", 7), table(spark, d, "labels"), "source", "doc_id")


def _notifications(spark, d):
    ticket = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("id"), ticket.alias("ticket_id"), (F.col("value") > 50).alias("read"), "ts")


def notifications_read(spark, d):
    notes = _notifications(spark, d)
    opened = activity.latest(notes, "uid", "ts", "id")
    return activity.mark_read(notes.drop("ts"), opened).groupBy("uid").agg(F.count_if("read").alias("read"), F.count_if(~F.col("read")).alias("unread"))


def newest_notifications(spark, d):
    return activity.newest(_notifications(spark, d), "uid", "ts", "id").select("uid", "id", "n")


def attachment_counts(spark, d):
    sent = table(spark, d, "conversations").select("conv_id", F.struct(F.regexp_extract_all("text", F.lit(r"\w+ing"), 0).alias("attachments")).alias("m"))
    return sent.groupBy("conv_id").agg(activity.attachment_count(F.collect_list("m")).alias("attachments"))


QUERIES = {f.__name__: f for f in (sentence_cards, plan_progress, notifications_read, newest_notifications, attachment_counts, stream_sessions, stream_activity, page_structure, bank_blocks, ocr_pages, embedded_questions, change_log, activity_counters)}

ORACLES = {
    "sentence_cards": r"""WITH p AS (SELECT doc_id, unnest(x) AS text, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS page FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(12)) AS x FROM documents)),
        c AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n{2,}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS x FROM p),
        a AS (SELECT doc_id, page, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS n, unnest(x) AS answer FROM c)
        SELECT doc_id, page, n, 'Recall the key idea: ' || array_to_string(regexp_split_to_array(answer, '\s+')[1:5], ' ') || '…' AS prompt, answer FROM a""",
    "plan_progress": "SELECT source, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS done, count(*) AS items FROM documents GROUP BY source",
    "notifications_read": """WITH n AS (SELECT user_id AS uid, event_id AS id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS ticket, value > 50 AS read, ts FROM events),
        o AS (SELECT uid, id, ticket FROM n QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts DESC, id DESC) = 1)
        SELECT n.uid, count(*) FILTER (n.read OR n.id = o.id OR (o.ticket <> '' AND n.ticket = o.ticket)) AS read,
               count(*) FILTER (NOT (n.read OR n.id = o.id OR (o.ticket <> '' AND n.ticket = o.ticket))) AS unread FROM n JOIN o ON n.uid = o.uid GROUP BY n.uid""",
    "newest_notifications": "SELECT user_id AS uid, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM events QUALIFY n <= 30",
    "attachment_counts": r"SELECT conv_id, CAST(sum(coalesce(len(regexp_extract_all(text, '\w+ing')), 0)) AS BIGINT) AS attachments FROM conversations GROUP BY conv_id",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 300000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM s GROUP BY user_id, session""",
    "stream_activity": "SELECT epoch_us(date_trunc('hour', ts)) AS started, event_type, count(*) AS events FROM events GROUP BY ALL",
    "ocr_pages": r"""WITH l AS (SELECT doc_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS page FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
        b AS (SELECT *, len(regexp_extract_all(line, '\p{L}{3,}')) < 2 AS blank FROM l), s AS (SELECT *, avg(CAST(blank AS INTEGER)) OVER (PARTITION BY doc_id) AS share FROM b),
        r AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM s WHERE blank AND (share > 0.5 OR page % 2 = 0)) SELECT doc_id, page FROM r WHERE r <= 80""",
    "change_log": """WITH g AS (SELECT l_orderkey AS id, l_linenumber * 100000000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq,
          max(struct_pack(op := CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'set' ELSE 'update' END, status := l_linestatus, part := CAST(l_partkey AS VARCHAR))) AS m FROM lineitem GROUP BY 1, 2),
        l AS (SELECT id, seq, m.op AS op, m.status AS status, m.part AS part FROM g), x AS (SELECT *, max(seq) FILTER (op <> 'update') OVER (PARTITION BY id) AS reset FROM l), y AS (SELECT * FROM x WHERE reset IS NULL OR seq >= reset)
        SELECT id, arg_max(status, seq) AS status, arg_max(part, seq) AS part FROM y WHERE op <> 'delete' GROUP BY id""",
    "activity_counters": "SELECT user_id AS uid, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS value, max(ts) AS last_seen FROM events GROUP BY 1",
}
