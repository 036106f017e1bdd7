"""Registered queries of trees, users, activity and access, with their check queries.

Regions, nations, customers and suppliers make the tree (subject, folder, files); orders
are tickets, labels are feedback, events are heartbeats. ``now`` is the newest event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import activity, fuzzy, policy, tree
from ..sources.tables import table
from . import sql as S


def _nodes(spark, d) -> DataFrame:
    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    none = F.lit(None).cast("string")
    parts = [
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("subject").alias("kind"), F.col("r_name").alias("name"), none.alias("parent_id"), F.when(F.col("r_regionkey") % 3 == 0, "mid").otherwise("both").alias("exam")),
        n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("folder"), F.col("n_name"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 4 == 0, "end").otherwise("")),
        c.select(F.concat(F.lit("c"), "c_custkey"), F.lit("file"), F.col("c_name"), F.concat(F.lit("n"), "c_nationkey"), none),
        s.select(F.concat(F.lit("s"), "s_suppkey"), F.lit("file"), F.col("s_name"), F.concat(F.lit("n"), "s_nationkey"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def children_sorted(spark, d):
    return tree.children(_nodes(spark, d))


def paths(spark, d):
    return tree.paths(_nodes(spark, d))


def descendants(spark, d):
    return tree.descendants(_nodes(spark, d), F.lit("r1"))


def subtree_counts(spark, d):
    return tree.subtree_counts(_nodes(spark, d))


def visible_nodes(spark, d):
    return tree.visible(_nodes(spark, d), "end")


def name_search(spark, d):
    return tree.name_search(_nodes(spark, d), "nation_1 customer")


def move_subtree(spark, d):
    return tree.move(_nodes(spark, d), "n3", "r0")


def copy_subtree(spark, d):
    return tree.copy(_nodes(spark, d), "r2", None, "op-1")


def transfer_problems(spark, d):
    n = _nodes(spark, d)
    moves = n.select("id", F.when(F.col("kind") == "folder", F.lit("r1")).when(F.col("kind") == "subject", F.lit("n1")).alias("target"))
    return tree.transfer_problem(n, moves)


def swap_scopes(spark, d):
    return tree.swap_scopes(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "BUILDING", "MACHINERY", "c_mktsegment")


def audit_batches(spark, d):
    changes = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("uid"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("file").alias("kind"), F.lit("changed").alias("summary"))
    return tree.audit_entries(changes, "move", "id", 4).select("uid", "action", "summary", "part", "count", F.transform("items", lambda x: x["id"]).alias("ids")).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


def _now(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("now"))


def last_seen(spark, d):
    return activity.last_seen(table(spark, d, "events"))


def active_now(spark, d):
    seen = activity.last_seen(table(spark, d, "events")).crossJoin(F.broadcast(_now(spark, d)))  # one row
    return seen.select("user_id", activity.is_active(F.col("last_active"), F.col("now")).alias("active_now"), activity.is_active(F.col("last_active"), F.col("now"), 7 * 86400).alias("active_week"))


def weekly_active(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("events"))


def ban_states(spark, d):
    """Every error suspends its user for an hour times its value; a negative value blocks."""
    e = table(spark, d, "events").where("event_type = 'error'")
    bans = activity.latest(e, "user_id", "ts", "event_id").crossJoin(F.broadcast(_now(spark, d)))
    until = F.col("ts") + F.make_dt_interval(F.lit(0), F.floor("value").cast("int"))
    return bans.select("user_id", activity.ban_state(F.when(F.col("event_id") % 3 == 0, "blocked").otherwise("suspended"), until, F.col("now")).alias("state"))


def heartbeat_sessions(spark, d):
    return activity.sessions(table(spark, d, "events"))


def _feedback(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    kinds = T.strings(W.FEEDBACK_KINDS)
    return l.select("doc_id", "source", F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("kind"), F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("verdict"), F.when(F.col("toxic") == 1, F.col("lang")).otherwise("").alias("comment"))


def overview_stats(spark, d):
    return activity.overview(_feedback(spark, d))


def feedback_by_kind(spark, d):
    v = F.col("verdict")
    return activity.zero_filled(_feedback(spark, d), "kind", W.FEEDBACK_KINDS, correct=v == "correct", wrong=v == "wrong")


def status_counts(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved")
    return activity.zero_filled(table(spark, d, "orders").withColumn("status", status), "status", W.TICKET_STATUSES, tickets=F.lit(True))


def prefix_users(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name").orderBy("c_name").limit(100)


def contains_search(spark, d):
    return table(spark, d, "customer").where(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build"))).select("c_custkey", "c_mktsegment")


def facet_filter(spark, d):
    return activity.facets(_feedback(spark, d), verdict="wrong", kind="all", source="src1").select("doc_id", "kind")


def learning_memory(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.concat_ws(": ", "event_type", "props").alias("entry"))
    return activity.learning_memory(e, "user_id", "entry", "ts", "event_id")


def history_last_k(spark, d):
    return activity.history(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


def principals(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("email"))
    e = table(spark, d, "events").where("event_type = 'error'")
    bans = activity.latest(e, "user_id", "ts", "event_id").select(F.col("user_id").alias("uid"), F.lit("blocked").alias("type"), F.col("ts").alias("until"))
    supporters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("uid"))
    return activity.principals(users, bans, supporters, F.lit("2024-01-15").cast("timestamp_ntz"), ("customer#000000007",))


def only_changes(spark, d):
    before = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    after = before.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment"))})
    return activity.only_changes(before, after, "c_custkey", ("c_acctbal",)).select("c_custkey", F.array_join("changed", ",").alias("changed"), "accepted")


def erased_rows(spark, d):
    users = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    left = activity.erase({"orders": table(spark, d, "orders")}, users, "o_custkey")
    return left["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def export_json_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), "o_orderkey", "o_orderstatus")
    e = table(spark, d, "events").select(F.col("user_id").alias("uid"), "event_id", "event_type")
    return activity.export({"orders": o, "events": e}).groupBy("uid", "part").agg(F.count("*").alias("rows"), F.sum(F.length("body")).cast("long").alias("chars"))


def blob_roundtrip(spark, d):
    """Texts as base64 in pieces of 900 000 characters, put together again."""
    coded = table(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "utf-8")).alias("b"))
    bare = coded.select("doc_id", F.regexp_replace("b", r"\s", "").alias("b"))
    size = F.lit(900_000)
    pieces = bare.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("b") - 1, F.lit(0)) / size).cast("int")), lambda i: F.substr("b", i * size + 1, size))).alias("i", "s"))
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "").alias("b"), F.count("*").alias("pieces"))
    return whole.select("doc_id", "pieces", F.md5(F.unbase64("b")).alias("digest"))


def range_join_figures(spark, d):
    """Each shipped line belongs to the first order of the same customer segment group whose week holds it: a range join on bucketed weeks."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    joined = l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("start")) & (F.col("l_shipdate") < F.col("start") + F.expr("INTERVAL 30 DAYS")))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_shipdate", "l_linenumber"))
    return joined.withColumn("r", first).where("r = 1").select("o_orderkey", "l_linenumber")


def ticket_log(spark, d):
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ticket_id"), (F.col("l_linenumber") * 100_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("seq"), F.when(F.col("l_returnflag") == "R", "status").otherwise("reply").alias("action"), F.when(F.col("l_linestatus") == "F", "closed").otherwise("in_progress").alias("text"), F.col("l_shipdate").alias("at"))
    return activity.ticket_log(log)


def feedback_cube(spark, d):
    """Extension: all groupings of kind and verdict."""
    return _feedback(spark, d).cube("kind", "verdict").agg(F.count("*").alias("n")).select("kind", "verdict", "n")


def fuzzy_search(spark, d):
    return fuzzy.search(_nodes(spark, d).withColumn("keywords", F.array(F.lit("unit 2"), F.col("kind"))), "customr nation_1")


def _owned(spark, d) -> DataFrame:
    """Nodes with an owner (a third of the files are shared), a course and keywords."""
    n = F.regexp_extract("id", r"\d+", 0).cast("int")
    owner = F.when((F.col("kind") == "file") & (n % 3 > 0), F.concat(F.lit("user-"), n % 3))
    return _nodes(spark, d).withColumns({"owner": owner, "university": F.when(n % 5 == 0, "U1").otherwise("U2"), "year": n % 2, "keywords": F.array(F.lit("unit 2"), F.col("kind"))})


def policy_search(spark, d):
    who = policy.Policy("user-1", exam="end")
    return fuzzy.search(_owned(spark, d), "customr nation_1", policy=who, course={"university": "U1", "year": "1"})


def readable_nodes(spark, d):
    return policy.readable(_owned(spark, d), policy.Policy("user-2", exam="mid"))


def ranked_names(spark, d):
    return tree.ranked_names(_nodes(spark, d), "nation_1 0")


def fuzzy_words(spark, d):
    """How well each word of the part names matches slipped and shortened query words."""
    names = table(spark, d, "part").select(F.explode(T.search_tokens(F.col("p_name"))).alias("w")).distinct()
    asked = names.select(F.explode(F.array(F.col("w"), F.concat(F.substr("w", F.lit(2), F.lit(1)), F.substr("w", F.lit(1), F.lit(1)), F.substr("w", F.lit(3))), F.expr("left(w, length(w) - 1)"))).alias("q")).where("q <> ''").distinct()
    return fuzzy.word_matches(asked, names)


QUERIES = {f.__name__: f for f in (
    children_sorted, paths, descendants, subtree_counts, visible_nodes, name_search, move_subtree, copy_subtree, transfer_problems, swap_scopes, audit_batches, last_seen, active_now, weekly_active,
    ban_states, heartbeat_sessions, overview_stats, feedback_by_kind, status_counts, prefix_users, contains_search, facet_filter, learning_memory, history_last_k, principals, only_changes,
    erased_rows, export_json_counts, blob_roundtrip, range_join_figures, ticket_log, feedback_cube, fuzzy_search, policy_search, readable_nodes, ranked_names, fuzzy_words,
)}

_N = """n AS (SELECT 'r' || r_regionkey AS id, 'subject' AS kind, r_name AS name, NULL AS parent_id, CASE WHEN r_regionkey % 3 = 0 THEN 'mid' ELSE 'both' END AS exam FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'folder', n_name, 'r' || n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'end' ELSE '' END FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'file', c_name, 'n' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'file', s_name, 'n' || s_nationkey, NULL FROM supplier)"""
_UP = f"""WITH RECURSIVE {_N}, up(id, ancestor, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT up.id, n.parent_id, depth + 1 FROM up JOIN n ON up.ancestor = n.id WHERE n.parent_id IS NOT NULL)"""
_FB = f"""f AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN 'question' WHEN 1 THEN 'notes' WHEN 2 THEN 'summary' WHEN 3 THEN 'answer' ELSE 'chat' END AS kind,
  CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS verdict, CASE WHEN toxic = 1 THEN lang ELSE '' END AS comment FROM labels JOIN documents USING (doc_id))"""
_KIND = "CASE kind WHEN 'subject' THEN 0 WHEN 'folder' THEN 1 ELSE 2 END"

_OWNED = rf"""{_UP}, o AS (SELECT *, CASE WHEN kind = 'file' AND k % 3 > 0 THEN 'user-' || (k % 3) END AS owner, CASE WHEN k % 5 = 0 THEN 'U1' ELSE 'U2' END AS university, k % 2 AS year
  FROM (SELECT *, CAST(regexp_extract(id, '\d+') AS INTEGER) AS k FROM n))"""


def _readable(uid: str, exam: str) -> str:
    return f"(SELECT up.id FROM up JOIN o ON up.ancestor = o.id GROUP BY up.id HAVING bool_and((exam IS NULL OR exam IN ('', 'both', '{exam}')) AND (owner IS NULL OR owner = '{uid}')))"


def _search(seen: str, course: str) -> str:
    """The search for ``customr nation_1`` among the nodes ``seen``."""
    key = r"regexp_replace(lower(name), '\d+', lpad(regexp_extract(lower(name), '\d+'), 12, '0'))"
    return rf"""{_OWNED}, vis AS {seen},
tk AS (SELECT id, kind, name, university, year, list_filter(string_split(trim(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains({S.STOP}, t)) AS own
  FROM o WHERE id IN (SELECT id FROM vis)),
fw AS (SELECT id, unnest(own) AS w, 1.0::DOUBLE AS f FROM tk UNION ALL SELECT up.id, unnest(a.own), 0.7 FROM up JOIN tk a ON up.ancestor = a.id WHERE depth > 0 AND up.id IN (SELECT id FROM vis)
  UNION ALL SELECT id, unnest(['unit', '2', kind]), 0.55 FROM tk),
dq AS (SELECT q, w, {S.word_match("q", "w")} AS s FROM (SELECT unnest(['customr', 'nation', '1']) AS q), (SELECT DISTINCT w FROM fw)),
e0 AS (SELECT id, q, f * s AS m FROM fw JOIN dq USING (w) UNION ALL SELECT id, q, 0.95 FROM tk, (SELECT unnest(['customr', 'nation']) AS q) WHERE length(q) BETWEEN 2 AND 6 AND list_aggregate(list_transform(own, lambda t: left(t, 1)), 'string_agg', '') = q),
e AS (SELECT id, q, max(m) AS m FROM e0 GROUP BY ALL),
sc AS (SELECT id, sum(m) / 3 AS s, count(*) FILTER (m >= 0.5) AS matched FROM e GROUP BY id),
z AS (SELECT id, name, round(s * CASE WHEN {course} THEN 1.12 ELSE 1.0 END * CASE WHEN kind <> 'file' THEN 1.03 ELSE 1.0 END, 9) AS score, matched / 3 AS coverage, matched = 3 AS matched_all FROM sc JOIN tk USING (id) WHERE matched > 0),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY matched_all DESC, CASE WHEN matched_all THEN 0 ELSE -coverage END, score DESC, {key}, id) AS INTEGER) AS place, count(*) FILTER (matched_all) OVER () AS n FROM z)
SELECT id, name, score, coverage, matched_all, place FROM p
WHERE CASE WHEN matched_all THEN place <= 60 ELSE n < 3 AND coverage >= CASE WHEN n > 0 THEN 0.5 ELSE 0.3 END AND place - n <= 12 END"""


ORACLES = {
    "fuzzy_search": _search("(SELECT id FROM o)", "false"),
    "policy_search": _search(_readable("user-1", "end"), "university = 'U1' AND year = 1"),
    "readable_nodes": f"{_OWNED} SELECT id FROM {_readable('user-2', 'mid')}",
    "fuzzy_words": rf"""WITH n AS (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains({S.STOP}, t))) AS w FROM part),
        a AS (SELECT DISTINCT q FROM (SELECT unnest([w, substr(w, 2, 1) || substr(w, 1, 1) || substr(w, 3), left(w, length(w) - 1)]) AS q FROM n) WHERE q <> ''),
        m AS (SELECT q, w, {S.word_match("q", "w")} AS s FROM a, n) SELECT q, w, CAST(s AS DOUBLE) AS score FROM m WHERE s > 0""",
    "ranked_names": rf"""{_UP}, p AS (SELECT up.id, string_agg(name, ' ' ORDER BY depth DESC) AS path FROM up JOIN n ON up.ancestor = n.id GROUP BY up.id),
        f AS (SELECT id, kind, name, path, contains(lower(name), 'nation_1')::INT + contains(lower(name), '0')::INT AS score FROM p JOIN n USING (id) WHERE contains(lower(path), 'nation_1') AND contains(lower(path), '0')),
        r AS (SELECT id, score, path, CAST(row_number() OVER (ORDER BY score DESC, {_KIND}, regexp_replace(lower(name), '\d+', lpad(regexp_extract(lower(name), '\d+'), 12, '0')), id) AS INTEGER) AS place FROM f)
        SELECT * FROM r WHERE place <= 60""",
    "children_sorted": f"""WITH {_N} SELECT parent_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY {_KIND}, lower(regexp_extract(name, '^\\D*')), CAST(coalesce(nullif(regexp_extract(name, '\\d+'), ''), '0') AS BIGINT), id) - 1 AS INTEGER) AS position, id, name FROM n""",
    "paths": f"{_UP} SELECT up.id, CAST(max(depth) AS INTEGER) AS depth, string_agg(name, ' › ' ORDER BY depth DESC) AS path FROM up JOIN n ON up.ancestor = n.id GROUP BY up.id",
    "descendants": f"{_UP} SELECT id, CAST(depth AS INTEGER) AS depth FROM up WHERE ancestor = 'r1'",
    "subtree_counts": f"""{_UP}, b AS (SELECT ancestor AS id, count(*) FILTER (kind = 'folder') AS folders, count(*) FILTER (kind = 'file') AS files FROM up JOIN n USING (id) WHERE depth > 0 GROUP BY ancestor)
        SELECT n.id, coalesce(folders, 0) AS folders, coalesce(files, 0) AS files FROM n LEFT JOIN b USING (id) WHERE kind <> 'file'""",
    "visible_nodes": f"{_UP} SELECT up.id FROM up JOIN n ON up.ancestor = n.id GROUP BY up.id HAVING bool_and(exam IS NULL OR exam IN ('', 'both', 'end'))",
    "name_search": f"""{_UP}, p AS (SELECT up.id, string_agg(name, ' ' ORDER BY depth DESC) AS path FROM up JOIN n ON up.ancestor = n.id GROUP BY up.id)
        SELECT id, CAST(contains(lower(name), 'nation_1') AS INTEGER) + CAST(contains(lower(name), 'customer') AS INTEGER) AS score, path FROM p JOIN n USING (id) WHERE contains(lower(path), 'nation_1') AND contains(lower(path), 'customer')""",
    "move_subtree": f"""{_UP}, b AS (SELECT id, depth FROM up WHERE ancestor = 'n3')
        SELECT n.id, CASE WHEN depth IS NULL OR kind = 'file' THEN kind WHEN depth = 0 THEN 'folder' WHEN kind = 'subject' THEN 'folder' ELSE kind END AS kind, name, CASE WHEN depth = 0 THEN 'r0' ELSE parent_id END AS parent_id, exam FROM n LEFT JOIN b USING (id)""",
    "transfer_problems": f"""{_UP}, m AS (SELECT id, kind, parent_id, CASE kind WHEN 'folder' THEN 'r1' WHEN 'subject' THEN 'n1' END AS target FROM n)
        SELECT m.id, target, CASE WHEN kind = 'file' AND target IS NULL THEN 'a file needs a folder' WHEN parent_id IS NOT DISTINCT FROM target THEN 'already there' WHEN up.id IS NOT NULL THEN 'a folder cannot go inside itself' END AS problem
        FROM m LEFT JOIN up ON up.id = m.target AND up.ancestor = m.id""",
    "swap_scopes": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "audit_batches": """WITH b AS (SELECT o_custkey AS uid, o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 + 1 AS part, (count(*) OVER (PARTITION BY o_custkey) + 3) // 4 AS parts FROM orders)
        SELECT CAST(uid AS BIGINT) AS uid, 'move' AS action, 'changed' || CASE WHEN parts > 1 THEN ' (part ' || part || ' of ' || parts || ')' ELSE '' END AS summary, CAST(part AS INTEGER) AS part, count(*) AS count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM b GROUP BY uid, part, parts""",
    "last_seen": "SELECT user_id, max(ts) AS last_active, count(*) AS events FROM events GROUP BY user_id",
    "active_now": "WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, max(ts) AS l FROM events GROUP BY user_id) SELECT user_id, epoch_us(now) - epoch_us(l) < 300000000 AS active_now, epoch_us(now) - epoch_us(l) < 604800000000 AS active_week FROM s, n",
    "weekly_active": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY 1",
    "ban_states": """WITH n AS (SELECT max(ts) AS now FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error')
        SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'blocked' WHEN ts + to_hours(CAST(floor(value) AS INTEGER)) > now THEN 'suspended' END AS state FROM b, n WHERE r = 1""",
    "heartbeat_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 300000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY ALL""",
    "overview_stats": f"WITH {_FB} SELECT count(*) AS feedback, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict <> 'correct') AS wrong, count(*) FILTER (comment <> '') AS comments, CAST(floor(count(*) FILTER (verdict = 'correct') * 100 / count(*) + 0.5) AS BIGINT) AS accuracy FROM f",
    "feedback_by_kind": f"WITH {_FB}, k AS (SELECT unnest(['question', 'notes', 'summary', 'answer', 'chat', 'interview']) AS kind) SELECT kind, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong FROM k LEFT JOIN f USING (kind) GROUP BY kind",
    "status_counts": "WITH k AS (SELECT unnest(['open', 'in_progress', 'resolved', 'closed']) AS status), o AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'resolved' END AS status FROM orders) SELECT k.status, count(o.status) AS tickets FROM k LEFT JOIN o ON k.status = o.status GROUP BY k.status",
    "prefix_users": "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name LIMIT 100",
    "contains_search": "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')",
    "facet_filter": f"WITH {_FB} SELECT doc_id, kind FROM f WHERE verdict = 'wrong' AND source = 'src1'",
    "learning_memory": """WITH e AS (SELECT user_id, left(concat_ws(': ', event_type, props), 300) AS entry, max((ts, event_id)) AS newest FROM events GROUP BY ALL), r AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS INTEGER) AS place, entry FROM e) SELECT * FROM r WHERE place <= 25""",
    "history_last_k": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role FROM r WHERE k <= 3",
    "principals": """WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT c_custkey AS uid, lower(c_name) = 'customer#000000007' AS is_admin, s_suppkey IS NOT NULL AS is_supporter, user_id IS NOT NULL AS banned, lower(c_name) = 'customer#000000007' OR user_id IS NULL AS allowed
        FROM customer LEFT JOIN b ON user_id = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "only_changes": """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'c_acctbal' END, CASE WHEN c_custkey % 5 = 0 THEN 'c_mktsegment' END) AS changed, c_custkey % 5 <> 0 AS accepted FROM customer""",
    "erased_rows": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1",
    "blob_roundtrip": "SELECT doc_id, CAST(greatest(1, ceil(length(to_base64(encode(text))) / 900000)) AS BIGINT) AS pieces, md5(text) AS digest FROM documents",
    "range_join_figures": """WITH j AS (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY) SELECT o_orderkey, l_linenumber FROM j WHERE r = 1""",
    "ticket_log": """SELECT l_orderkey AS ticket_id, coalesce(arg_max(CASE WHEN l_linestatus = 'F' THEN 'closed' ELSE 'in_progress' END, l_linenumber * 100000000000 + l_partkey * 1000 + l_suppkey % 1000) FILTER (l_returnflag = 'R'), 'open') AS status, count(*) FILTER (l_returnflag <> 'R') AS messages, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1""",
    "feedback_cube": f"WITH {_FB} SELECT kind, verdict, count(*) AS n FROM f GROUP BY CUBE (kind, verdict)",
}
