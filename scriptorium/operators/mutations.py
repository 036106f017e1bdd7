"""Tables folded from logs of changes, options, and checks of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(log: DataFrame) -> DataFrame:
    """``id, fields`` after ``log(seq, id, op, patch map<string,string>)``: ``set`` replaces a
    row, ``update`` changes named fields, ``delete`` removes it; later changes win. Changes
    before a row's last ``set`` or ``delete`` don't count."""
    per = Window.partitionBy("id")
    reset = F.max(F.when(F.col("op").isin("set", "delete"), F.col("seq"))).over(per)
    live = log.withColumn("__reset", reset).where(F.col("__reset").isNull() | (F.col("seq") >= F.col("__reset")))
    deleted = live.where("op = 'delete'").select("id").distinct()
    fields = live.where("op <> 'delete'").select("id", "seq", F.explode("patch").alias("k", "v"))
    newest = fields.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    made = newest.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
    revived = live.where("op <> 'delete'").groupBy("id").agg(F.max("seq").alias("s")).join(live.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("d")), "id").where("s > d").select("id")
    gone = deleted.join(revived, "id", "left_anti")
    return made.join(gone, "id", "left_anti")


def counters(log: DataFrame, key: str = "uid") -> DataFrame:
    """``uid, value, last_seen`` of deltas ``(uid, delta, at)``."""
    return log.groupBy(key).agg(F.sum("delta").alias("value"), F.max("at").alias("last_seen"))


def option_edited(options: Column, add: str | None = None, remove: str | None = None) -> Column:
    """A list with ``add`` (unless it is there in any casing) and without ``remove``."""
    out = options
    if add and add.strip():
        there = F.exists(options, lambda x: F.lower(x) == add.strip().lower())
        out = F.when(there, out).otherwise(F.array_append(out, F.lit(add.strip())))
    return F.filter(out, lambda x: x != F.lit(remove)) if remove is not None else out


def interleaved(a: Column, b: Column, most: int) -> Column:
    """Two lists taken in turn, without repeats, ``most`` at most."""
    pairs = F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.array(x["a"], x["b"])))
    return F.slice(F.array_distinct(F.array_compact(pairs)), 1, most)


def appeal_allowed(tickets: DataFrame, principals: DataFrame) -> DataFrame:
    """``tickets`` with ``accepted``: anyone allowed may write; a banned user has one appeal of one message."""
    joined = tickets.join(principals.select("uid", "banned"), "uid", "left").withColumn("banned", F.coalesce("banned", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("uid").orderBy("created_at", "id"))
    return joined.withColumn("accepted", ~F.col("banned") | ((F.col("category") == "appeal") & (F.size("messages") == 1) & (nth == 1)))


def valid_audit(entries: DataFrame) -> DataFrame:
    """``entries`` with ``problem`` where their shape isn't that of an audit row."""
    return entries.withColumn("problem", F.when(F.col("uid").isNull(), "uid").when(~F.length("summary").between(1, 1000), "summary").when(F.size("items") > 50, "items").when(F.col("count") < F.size("items"), "count"))
