"""Trees as adjacency lists ``(id, kind, name, parent_id, ...)``: closure, order, moves, copies, audit.

The closure (every node with each of its ancestors) is made by doubling: paths of up to 2, 4,
8 ... steps, each round one join, so rounds grow with the logarithm of the depth, and neither
depth nor the number of nodes has a limit. What lies below one node is found in as many rounds
from one row a node, without the closure. A walk upwards stops at a missing parent; parents in
a circle are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settle

AUDIT_ACTIONS = ("add", "upload", "rename", "exam", "icon", "edit", "move", "copy", "move-course", "swap-course")


class Circle(ValueError):
    """A node is its own ancestor."""


def _known_parents(nodes: DataFrame) -> DataFrame:
    """``id, parent``: the parent is null where there is none or no such node."""
    known = nodes.select(F.col("id").alias("parent")).distinct()
    edges = nodes.select("id", "parent_id").distinct()
    return edges.join(known, edges["parent_id"] == known["parent"], "left").select("id", "parent")


def closure(nodes: DataFrame) -> DataFrame:
    """``id, ancestor, depth``: every node with itself (0), its parent (1) and so on."""
    steps = 1
    found = last = settle(_known_parents(nodes).where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "up")
    while last.where(F.col("depth") == steps).limit(1).count():
        if last.where("id = ancestor").limit(1).count():
            raise Circle("parents in a circle")
        # paths of exactly ``steps`` steps, lengthened by all known ones
        far = last.where(F.col("depth") == steps).select("id", F.col("ancestor").alias("via"), "depth")
        near = found.select(F.col("id").alias("via"), "ancestor", F.col("depth").alias("more"))
        last = settle(far.join(near, "via").select("id", "ancestor", (F.col("depth") + F.col("more")).alias("depth")), "up")
        found = found.unionByName(last)
        steps *= 2
    return nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct().unionByName(found)


def kind_order(kind: Column) -> Column:
    return F.when(kind == "subject", 0).when(kind == "folder", 1).otherwise(2)


def children(nodes: DataFrame) -> DataFrame:
    """``parent_id, position, id, name``: folders first, names in natural order."""
    order = Window.partitionBy("parent_id").orderBy(kind_order(F.col("kind")), T.natural_key(F.col("name")), "id")
    return nodes.select("parent_id", (F.row_number().over(order) - 1).alias("position"), "id", "name")


def paths(nodes: DataFrame, separator: str = " › ") -> DataFrame:
    """``id, depth, path``: the names from the top down to each node."""
    named = closure(nodes).join(nodes.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))), lambda x: x["name"])
    return named.groupBy("id").agg(F.max("depth").alias("depth"), F.array_join(ordered, separator).alias("path"))


def descendants(nodes: DataFrame, root: Column) -> DataFrame:
    """``id, depth`` of everything below and including the node ``root``. Each row knows how far
    it is from the root, if that is less than the steps so far, and who is that many steps up."""
    is_root = F.col("id") == root
    state = _known_parents(nodes).select("id", F.when(~is_root, F.col("parent")).alias("up"), F.when(is_root, 0).alias("depth"))
    steps = 1
    state = settle(state, "below")
    while state.where("up is not null and depth is null").limit(1).count():
        if steps > 1 << 40:
            raise Circle("parents in a circle")
        over = state.select(F.col("id").alias("up"), F.col("up").alias("beyond"), F.col("depth").alias("over"))
        joined = state.join(over, "up", "left")
        state = settle(joined.select("id", F.col("beyond").alias("up"), F.coalesce("depth", F.col("over") + steps).alias("depth")), "below")
        steps *= 2
    return state.where("depth is not null").select("id", "depth")


def preorder(nodes: DataFrame, root: Column) -> DataFrame:
    """``id, depth, place``: the descendants of ``root``, parents before children and these as
    ``children`` orders them; ``place`` is an array by which rows sort so."""
    below = descendants(nodes, root)
    sort_key = F.struct(kind_order(F.col("kind")).alias("kind"), T.natural_key(F.col("name")).alias("name"), F.col("id").alias("id"))
    inside = nodes.join(below, "id", "left_semi")
    named = closure(inside).join(nodes.select(F.col("id").alias("ancestor"), sort_key.alias("k")), "ancestor")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "k"))), lambda x: x["k"])
    return named.groupBy("id").agg(ordered.alias("place")).join(below, "id").select("id", "depth", "place")


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """``id, folders, files`` below each node that isn't a file."""
    below = closure(nodes).where("depth > 0").join(nodes.select("id", "kind"), "id")
    counts = below.groupBy(F.col("ancestor").alias("id")).agg(F.count_if(F.col("kind") == "folder").alias("folders"), F.count_if(F.col("kind") == "file").alias("files"))
    some = nodes.where("kind <> 'file'").select("id")
    return some.join(counts, "id", "left").select("id", F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce("files", F.lit(0)).alias("files"))


def exam_fits(exam: Column, wanted: str) -> Column:
    return F.lit(wanted == "all") | exam.isNull() | exam.isin("", "both", wanted)


def visible(nodes: DataFrame, wanted: str) -> DataFrame:
    """The ids of nodes that fit ``wanted`` together with all of their ancestors."""
    fits = nodes.select(F.col("id").alias("ancestor"), exam_fits(F.col("exam"), wanted).alias("fits"))
    return closure(nodes).join(fits, "ancestor").groupBy("id").agg(F.every("fits").alias("seen")).where("seen").select("id")


def name_search(nodes: DataFrame, query: str) -> DataFrame:
    """``id, score, path``: every word lies in the path; the score counts those in the own name."""
    ws = query.lower().split()
    own = sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in ws), F.lit(0))
    found = paths(nodes, " ")
    for w in ws:
        found = found.where(F.contains(F.lower("path"), F.lit(w)))
    return found.join(nodes.select("id", "name"), "id").select("id", own.alias("score"), "path")


def ranked_names(nodes: DataFrame, query: str, most: int = 60) -> DataFrame:
    """``name_search`` in the order shown: words in the own name, kind, name; ``place`` from 1, the first ``most``."""
    order = [F.desc("score"), kind_order(F.col("kind")), T.natural_key(F.col("name")), F.col("id")]
    first = name_search(nodes, query).join(nodes.select("id", "kind", "name"), "id").orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("id", "score", "path", "place")


def transfer_problem(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``id, target, problem`` of ``moves(id, target)``; null: nothing stands against it."""
    inside = closure(nodes).select(F.col("id").alias("target"), F.col("ancestor").alias("id"), F.lit(True).alias("inside"))
    joined = moves.join(nodes.select("id", "kind", "parent_id"), "id", "left").join(inside, ["id", "target"], "left")
    problem = (
        F.when(F.col("kind").isNull(), "no such node")
        .when((F.col("kind") == "file") & F.col("target").isNull(), "a file needs a folder")
        .when(F.col("parent_id").eqNullSafe(F.col("target")), "already there")
        .when(F.col("inside"), "a folder cannot go inside itself")
    )
    return joined.select("id", "target", problem.alias("problem"))


def kind_at(kind: Column, is_root: Column, target: Column) -> Column:
    """At the top a folder becomes a subject; further down a subject becomes a folder."""
    return (
        F.when(kind == "file", "file").when(is_root & target.isNotNull(), "folder").when(is_root, "subject")
        .when(kind == "subject", "folder").otherwise(kind)
    )


def move(nodes: DataFrame, root, target) -> DataFrame:
    """``nodes`` after the subtree of ``root`` went below ``target`` (None: the top)."""
    key = nodes.schema["id"].dataType
    to = F.lit(target).cast(key)
    below = descendants(nodes, F.lit(root).cast(key)).withColumnRenamed("depth", "__depth")
    is_root = F.col("__depth") == 0
    joined = nodes.join(below, "id", "left")
    return joined.withColumns({
        "kind": F.when(F.col("__depth").isNotNull(), kind_at(F.col("kind"), is_root, to)).otherwise(F.col("kind")),
        "parent_id": F.when(is_root, to).otherwise(F.col("parent_id")),
    }).select(*nodes.columns)


def copy(nodes: DataFrame, root, target, operation: str) -> DataFrame:
    """The rows that copy the subtree of ``root`` below ``target``. New ids follow from the
    old ones and ``operation``; beside its original a copy is named so."""
    key = nodes.schema["id"].dataType
    to = F.lit(target).cast(key)
    fresh = lambda c: F.xxhash64(F.lit(operation), c).cast(key)
    inside = descendants(nodes, F.lit(root).cast(key)).withColumnRenamed("depth", "__depth")
    is_root = F.col("__depth") == 0
    beside = is_root & F.col("parent_id").eqNullSafe(to)
    rows = nodes.join(inside, "id").withColumns({
        "kind": kind_at(F.col("kind"), is_root, to),
        "name": F.when(beside, F.concat("name", F.lit(" (copy)"))).otherwise(F.col("name")),
        "__parent": F.when(is_root, to).otherwise(fresh(F.col("parent_id"))),
    })
    return rows.withColumns({"id": fresh(F.col("id")), "parent_id": F.col("__parent")}).select(*nodes.columns)


def swap_scopes(nodes: DataFrame, one: str, other: str, scope: str = "scope") -> DataFrame:
    """Two courses exchange all of their material."""
    return nodes.withColumn(scope, F.when(F.col(scope) == one, other).when(F.col(scope) == other, one).otherwise(F.col(scope)))


def batches(changes: DataFrame, by: str, size: int = 400) -> DataFrame:
    """``changes(uid, id, name, kind, summary)`` with ``part`` and ``parts``: at most ``size`` a batch, in order of ``by``."""
    per = Window.partitionBy("uid")
    n = F.row_number().over(per.orderBy(by)) - 1
    return changes.withColumns({"part": (F.floor(n / size) + 1).cast("int"), "parts": F.ceil(F.count("*").over(per) / size).cast("int")})


def audit_entries(changes: DataFrame, action: str, by: str = "id", size: int = 400) -> DataFrame:
    """One audit row a batch: trimmed texts, the first 50 items, and how many there were."""
    kept = action if action in AUDIT_ACTIONS else "edit"
    items = F.slice(F.array_sort(F.collect_list(F.struct(F.col(by), F.substring("name", 1, 120).alias("name"), "kind"))), 1, 50)
    part = F.when(F.col("parts") > 1, F.format_string(" (part %d of %d)", "part", "parts")).otherwise("")
    return (
        batches(changes, by, size).groupBy("uid", "summary", "part", "parts").agg(F.count("*").alias("count"), items.alias("items"))
        .select("uid", F.lit(kept).alias("action"), F.substring(F.concat("summary", part), 1, 1000).alias("summary"), "part", "count", "items")
    )
