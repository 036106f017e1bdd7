"""Users, activity, bans, tickets, feedback: dashboards, latest states, access, erasure. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W

ACTIVE_SECONDS = 300


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("last_active"), F.count("*").alias("events"))


def is_active(last: Column, now: Column, seconds: int = ACTIVE_SECONDS) -> Column:
    return last.isNotNull() & (T.micros(now) - T.micros(last) < seconds * 1_000_000)


def latest(rows: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """The last row of each key."""
    per = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("__r", F.row_number().over(per)).where("__r = 1").drop("__r")


def ban_state(kind: Column, until: Column, now: Column) -> Column:
    """``blocked``, ``suspended`` while it lasts, or null."""
    return F.when(kind == "suspended", F.when(until > now, "suspended")).when(kind.isNotNull(), "blocked")


def zero_filled(rows: DataFrame, column: str, domain, **counts: Column) -> DataFrame:
    """Counts by ``column`` for every value of ``domain``, also those without rows."""
    spark = rows.sparkSession
    all_of = spark.createDataFrame([(v,) for v in domain], [column])
    grouped = rows.groupBy(column).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return all_of.join(grouped, column, "left").select(column, *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def overview(feedback: DataFrame) -> DataFrame:
    """One row over ``feedback(verdict, comment)``: totals and accuracy in per cent."""
    right = F.count_if(F.col("verdict") == "correct")
    return feedback.agg(
        F.count("*").alias("feedback"), right.alias("correct"), (F.count("*") - right).alias("wrong"), F.count_if(F.coalesce("comment", F.lit("")) != "").alias("comments"),
        T.js_round(F.try_divide(right * F.lit(100.0), F.count("*"))).alias("accuracy"),
    )


def learning_memory(entries: DataFrame, by: str, text: str, order: str, tie: str, most: int = 25) -> DataFrame:
    """``by, place, text``: distinct entries of each user, the newest first."""
    clipped = entries.withColumn("__t", F.substring(text, 1, 300))
    newest = clipped.groupBy(by, "__t").agg(F.max(F.struct(order, tie)).alias("at"))
    per = Window.partitionBy(by).orderBy(F.desc("at"))
    return newest.withColumn("place", F.row_number().over(per)).where(F.col("place") <= most).select(by, "place", F.col("__t").alias(text))


def history(turns: DataFrame, most: int) -> DataFrame:
    """The last ``most`` turns of each conversation."""
    per = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("__r", F.row_number().over(per)).where(F.col("__r") <= most).drop("__r")


def facets(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows that fit every facet; ``all`` fits any value."""
    for column, value in wanted.items():
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows


def sessions(events: DataFrame, gap_seconds: int = ACTIVE_SECONDS) -> DataFrame:
    """``user_id, session, started, ended, events``: a gap of ``gap_seconds`` ends a session."""
    per = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce(T.micros(F.col("ts")) - T.micros(F.lag("ts").over(per)) >= gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("new", fresh.cast("int")).withColumn("session", F.sum("new").over(per))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def principals(users: DataFrame, bans: DataFrame, supporters: DataFrame, now: Column, admins: tuple[str, ...] = ()) -> DataFrame:
    """``uid, is_admin, is_supporter, banned, allowed`` from ``users(uid, email)``, ``bans(uid, type, until)``, ``supporters(uid)``."""
    state = bans.select("uid", ban_state(F.col("type"), F.col("until"), now).isNotNull().alias("b"))
    marked = users.join(state, "uid", "left").join(supporters.select("uid", F.lit(True).alias("s")), "uid", "left")
    admin = F.lower("email").isin(*admins) if admins else F.lit(False)
    return marked.select("uid", admin.alias("is_admin"), F.coalesce("s", F.lit(False)).alias("is_supporter"), F.coalesce("b", F.lit(False)).alias("banned"), (admin | ~F.coalesce("b", F.lit(False))).alias("allowed"))


def only_changes(before: DataFrame, after: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """``key, changed, accepted``: whether an update touches allowed columns alone."""
    cols = [c for c in before.columns if c != key]
    a, b = before.alias("a"), after.alias("b")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in cols]))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), changed.alias("changed")).withColumn("accepted", F.size(F.array_except("changed", T.strings(allowed))) == 0)


def audited(changes: DataFrame, audit: DataFrame) -> DataFrame:
    """Changes by supporters that have their audit entry in the same commit; others' stay."""
    own = changes.where("NOT supporter")
    covered = changes.where("supporter").join(audit.select("audit_id", "uid", "at"), ["audit_id", "uid", "at"], "left_semi")
    return own.unionByName(covered.select(*own.columns))


def erase(tables: dict[str, DataFrame], users: DataFrame, key: str = "uid") -> dict[str, DataFrame]:
    """Every table without the rows of ``users(uid)``."""
    return {name: t.join(users.select(key), key, "left_anti") if key in t.columns else t for name, t in tables.items()}


def export(tables: dict[str, DataFrame], key: str = "uid") -> DataFrame:
    """``uid, part, body``: a JSON line a row of every table, the rows kept apart so that no user's data meet in one task."""
    parts = [t.select(F.col(key), F.lit(name).alias("part"), F.to_json(F.struct(*t.columns)).alias("body")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Columns of ``new`` win where they aren't null; keys of either table stay."""
    b = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in new.columns if c != key], F.lit(True).alias("__new"))
    joined = old.join(b, key, "full_outer")
    return joined.select(*[F.col(c) if c == key or f"__{c}" not in joined.columns else F.coalesce(f"__{c}", c).alias(c) for c in old.columns])


def ticket_log(log: DataFrame) -> DataFrame:
    """``ticket_id, status, messages, last_at`` of an event log ``(ticket_id, seq, action, text, at)``."""
    status = F.max_by(F.when(F.col("action") == "status", F.col("text")), F.when(F.col("action") == "status", F.col("seq")))
    return log.groupBy("ticket_id").agg(F.coalesce(status, F.lit("open")).alias("status"), F.count_if(F.col("action") == "reply").alias("messages"), F.max("at").alias("last_at"))


def valid_tickets(tickets: DataFrame) -> DataFrame:
    """``tickets`` with ``problem``: null where subject, text and status are in order."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return tickets.withColumn("problem", F.when(~size("subject").between(1, 200), "subject").when(~size("text").between(1, 5000), "text").when(~F.col("status").isin(*W.TICKET_STATUSES), "status"))


def newest(notes: DataFrame, by: str, order: str, tie: str, most: int = 30) -> DataFrame:
    """The ``most`` newest notifications of each user, with ``n`` from 1."""
    latest_first = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return notes.withColumn("n", F.row_number().over(latest_first)).where(F.col("n") <= most)


def mark_read(notes: DataFrame, opened: DataFrame) -> DataFrame:
    """``notes(uid, id, ticket_id, read)`` after each user opened the notifications
    ``opened(uid, id)``: these are read, and so are all of the user's about the same tickets."""
    shown = notes.join(opened.select("uid", "id").distinct(), ["uid", "id"], "left_semi")
    tickets = shown.where(F.col("ticket_id") != "").select("uid", "ticket_id", F.lit(True).alias("by_ticket")).distinct()
    own = opened.select("uid", "id", F.lit(True).alias("by_id")).distinct()
    seen = F.col("read") | F.coalesce("by_id", F.lit(False)) | F.coalesce("by_ticket", F.lit(False))
    return notes.join(own, ["uid", "id"], "left").join(tickets, ["uid", "ticket_id"], "left").withColumn("read", seen).select(*notes.columns)


def attachment_count(messages: Column) -> Column:
    """Attachments in an array of messages, each with an array ``attachments``; null counts as none."""
    each = F.transform(messages, lambda m: F.coalesce(F.size(m["attachments"]), F.lit(0)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda n, x: n + F.greatest(x, F.lit(0))), F.lit(0)).cast("long")
