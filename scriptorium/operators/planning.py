"""Study plans: topics dealt onto days, review days at the end, minutes by weight.

A plan is any number of topics in an order, of one document or of several. Where a day ends
follows from sums over the topics before, which are made in two levels: rows are dealt by
ranges of (plan, order), summed within a range and then over the ranges before it, so that no
task holds a plan. A plan of at most ``FOLD`` topics is then one array of that many numbers;
for larger ones each day's first topic is found by an aggregation, one round a day.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settle
from .folds import day_numbers, topic_parts

FOLD = 50_000


def _checked(days: int, hours: float) -> tuple[int, int, int]:
    """Study days, minutes a day and reading minutes a day."""
    if not 1 <= days <= 60:
        raise ValueError("days: a whole number from 1 to 60")
    if not 0.5 <= hours <= 12:
        raise ValueError("hours: from 0.5 to 12")
    review = max(1, int(days / 6 + 0.5)) if days >= 3 else 0
    minutes = int(hours * 60 + 0.5)
    return max(1, days - review), minutes, max(10, minutes - 15)


def numbered(topics: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``topics`` with ``pos`` (from 0, in its plan) and ``before`` (words of the topics ahead)."""
    at = [by, *order, "title", "words"]
    dealt = settle(topics.repartitionByRange(*at).withColumn("block", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy(by, "block").orderBy(*order, "title", "words")
    rows = dealt.withColumns({"nth": F.row_number().over(inside), "upto": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    blocks = dealt.groupBy(by, "block").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    ahead = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = blocks.select(by, "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w"))
    met = rows.alias("r").join(sums.alias("s"), F.col(f"r.{by}").eqNullSafe(F.col(f"s.{by}")) & (F.col("r.block") == F.col("s.block")))
    return met.select("r.*", (F.col("nth") - 1 + F.col("n")).alias("pos"), (F.col("upto") - F.col("words") + F.col("w")).alias("before")).drop("block", "nth", "upto")


def day_starts(rows: DataFrame, by: str, days: int) -> DataFrame:
    """``by, starts``: the position of each study day's first topic, of ``numbered`` rows. A day
    ends where the middle of the next topic would pass an even share, or where every day left needs one."""
    whole = settle(rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("words").alias("total")), "plans")
    whole = whole.withColumn("days", F.least(F.lit(days).cast("long"), "n"))

    @F.pandas_udf("array<long>")
    def folded(weights: pd.Series) -> pd.Series:
        def starts(ws):
            found = day_numbers(list(ws), days)
            return [i for i, d in enumerate(found) if i == 0 or d != found[i - 1]]

        return weights.map(starts)

    same = lambda a, b: F.col(f"{a}.{by}").eqNullSafe(F.col(f"{b}.{by}"))
    small = rows.alias("r").join(whole.where(F.col("n") <= FOLD).alias("w"), same("r", "w"), "left_semi")
    listed = small.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"].cast("double")).alias("ws"))
    done = listed.select(by, folded("ws").alias("starts"))

    large = whole.where(F.col("n") > FOLD)
    if large.isEmpty():
        return done
    middles = rows.alias("r").join(large.alias("l"), same("r", "l"), "left_semi").select(by, "pos", "before", (F.col("before") + F.col("words") / 2).alias("middle"))
    middles = settle(middles, "middles")
    state = large.select(by, "n", "total", "days", F.array(F.lit(0).cast("long")).alias("starts"), F.lit(0).cast("long").alias("sum"))
    for day in range(1, days):
        state = settle(state, "days")
        share = F.col("total") / F.col("days")
        after = middles.alias("m").join(state.alias("s"), same("m", "s")).where((F.col("pos") > F.element_at("starts", -1)) & (F.lit(day) < F.col("days")))
        forced = F.col("pos") == F.col("n") - (F.col("days") - day)
        found = after.where((F.col("middle") - F.col("sum") > share) | forced).groupBy(F.col(f"s.{by}").alias(by)).agg(F.min(F.struct("pos", "before")).alias("next"))
        met = state.alias("s").join(found.alias("f"), same("s", "f"), "left")
        state = met.select(
            *[f"s.{c}" for c in (by, "n", "total", "days")],
            F.when(F.col("f.next").isNotNull(), F.array_append("s.starts", F.col("f.next.pos"))).otherwise(F.col("s.starts")).alias("starts"),
            F.coalesce("f.next.before", "s.sum").alias("sum"),
        )
    return done.unionByName(state.select(by, "starts"))


def plan(topics: DataFrame, by: str, order: str | list[str], days: int, hours: float = 2.0) -> DataFrame:
    """Per group ``by`` of ``topics(by, order, title, words, ...)``: its columns, ``day`` and ``minutes``.

    The heaviest day takes the whole reading time (an hour total less 15 minutes of practice,
    ten at least), others in proportion, five minutes at least; a day that would overflow is scaled down."""
    study, _, reading = _checked(days, hours)
    order = [order] if isinstance(order, str) else list(order)
    rows = settle(numbered(topics, by, order), "numbered")
    same = lambda a, b: F.col(f"{a}.{by}").eqNullSafe(F.col(f"{b}.{by}"))
    dated = rows.alias("r").join(day_starts(rows, by, study).alias("s"), same("r", "s"))
    day = F.size(F.filter("s.starts", lambda x: x <= F.col("r.pos")))
    dated = settle(dated.select("r.*", day.alias("day")), "dated")
    heaviest = dated.groupBy(by, "day").agg(F.sum("words").alias("load")).groupBy(by).agg(F.max("load").alias("heaviest"))
    share = dated.alias("r").join(heaviest.alias("h"), same("r", "h")).withColumn("m", F.greatest(F.lit(5), T.js_round(F.lit(float(reading)) * F.col("words") / F.col("heaviest"))))
    timed = share.select("r.*", "m")
    sums = timed.groupBy(by, "day").agg(F.sum("m").alias("sum"))
    met = timed.alias("r").join(sums.alias("d"), same("r", "d") & (F.col("r.day") == F.col("d.day")))
    fitted = F.when(F.col("sum") > reading, F.greatest(F.lit(5), F.floor(F.col("m") * reading / F.col("sum")))).otherwise(F.col("m"))
    return met.select(*[f"r.{c}" for c in topics.columns], "r.day", fitted.cast("long").alias("minutes"))


def topics_of(pages: DataFrame) -> DataFrame:
    """``doc_id, topic, title, first, pages`` of ``pages(doc_id, page, text)``: ``pages`` is an array of
    (page, words, heading), with one word more a page than it has.

    Headings that open a page, before any other line, start a topic (of several the last one);
    further down they belong to the text. A topic without a heading is called after the first
    heading-like line of its page, or "Page n". A document without any line has a topic a page."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    marked = F.transform(lines, lambda x: F.struct(T.heading_line(x).alias("head"), T.word_count(x).alias("n"), x.alias("line")))
    each = pages.select("doc_id", "page", T.heading_of(F.col("text")).alias("heading"), marked.alias("a"))
    body = F.array_position(F.transform("a", lambda x: x["head"]), False)  # the first line that is no heading; 0: none
    each = each.withColumn("lead", F.when(body == 0, F.size("a")).otherwise(body - 1).cast("int"))
    title = F.when(F.col("lead") > 0, T.tidy_title(T.strip(F.get("a", F.col("lead") - 1)["line"])))
    own = F.aggregate(F.slice("a", F.col("lead") + 1, F.greatest(F.size("a"), F.lit(1))), F.lit(0), lambda n, x: n + x["n"].cast("int"))
    flat = each.select("doc_id", "page", "heading", title.alias("title"), own.cast("long").alias("words"), (F.size("a") > F.col("lead")).alias("held"), (F.size("a") > 0).alias("lined"))
    per = Window.partitionBy("doc_id")
    cut = flat.withColumn("any", F.max("lined").over(per)).withColumn("n_pages", F.count("*").over(per))
    cut = cut.withColumn("topic", F.when(F.col("any"), F.sum(F.col("title").isNotNull().cast("long")).over(per.orderBy("page"))).otherwise(F.col("page").cast("long")))
    page = F.struct("page", (F.col("words") + 1).alias("words"), "heading")
    kept = cut.groupBy("doc_id", "topic", "n_pages").agg(
        F.array_sort(F.collect_list(F.when(F.col("held") | ~F.col("any"), page))).alias("pages"), F.min_by("title", "page").alias("title"), F.min(F.when(F.col("title").isNotNull(), F.col("page"))).alias("at")
    ).where(F.size("pages") > 0)
    one = F.get("pages", 0)
    named = F.coalesce("title", F.when(one["heading"] != "", one["heading"]), F.concat(F.lit("Page "), (one["page"] + 1).cast("string")))
    return kept.select("doc_id", "topic", named.alias("title"), F.least(F.coalesce("at", one["page"]), one["page"]).alias("first"), "pages")


def _parts(pages: Column, target: Column) -> Column:
    @F.pandas_udf("array<int>")
    def cut(words: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([topic_parts(list(w), t) for w, t in zip(words, targets, strict=True)])

    return cut(F.transform(pages, lambda p: p["words"].cast("double")), target)


def units(topics: DataFrame, by: str, days: int) -> DataFrame:
    """``topics_of`` rows, with their plan ``by``, cut into runs of pages where they are much larger than
    an even share of it: all other columns, ``part, title, start, end, words``."""
    sizes = topics.withColumn("words", F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + p["words"]))
    sizes = settle(sizes, "topics")
    target = sizes.groupBy(by).agg((F.sum("words") / days).alias("target"))
    met = sizes.alias("t").join(target.alias("g"), F.col(f"t.{by}").eqNullSafe(F.col(f"g.{by}"))).select("t.*", "target")
    cut = met.withColumn("p", _parts(F.col("pages"), F.col("target")))
    runs = F.transform(F.sequence(F.lit(0), F.element_at("p", -1)), lambda k: F.filter("pages", lambda x, i: F.get("p", i) == k))

    def name(done: Column, run: Column) -> Column:
        head, k = F.coalesce(F.get(run, 0)["heading"], F.lit("")), F.size(done)
        fresh = (head != "") & (head != F.col("title"))
        own = F.when((k == 0) & ~fresh, F.col("title")).when(fresh & ~F.array_contains(done, head), head)
        return F.array_append(done, F.coalesce(own, F.concat("title", F.lit(" (part "), (k + 1).cast("string"), F.lit(")"))))

    titles = F.when(F.size("runs") == 1, F.array("title")).otherwise(F.aggregate("runs", F.array().cast("array<string>"), name))
    listed = cut.withColumn("runs", runs).withColumn("titles", titles)
    rest = [c for c in topics.columns if c not in ("title", "first", "pages")]
    each = listed.select(*rest, "first", F.posexplode(F.arrays_zip("runs", "titles")).alias("part", "x"))
    start = F.when(F.col("part") == 0, F.least("first", F.get("x.runs", 0)["page"])).otherwise(F.get("x.runs", 0)["page"])
    words = F.aggregate("x.runs", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return each.select(*rest, "part", F.col("x.titles").alias("title"), start.alias("start"), F.element_at("x.runs", -1)["page"].alias("end"), words.alias("words"))


def multi_plan(pages: DataFrame, members: DataFrame, days: int, hours: float = 2.0) -> DataFrame:
    """One plan over several documents: ``plan, position, doc_id, topic, part, title, start, end, words, day,
    minutes`` for ``members(plan, position, doc_id)``; a document may be in any number of plans."""
    study, _, _ = _checked(days, hours)
    mine = topics_of(pages).join(members.select("plan", "position", "doc_id"), "doc_id")
    cut = units(mine.select("plan", "position", "doc_id", "topic", "title", "first", "pages"), "plan", study)
    return plan(cut, "plan", ["position", "topic", "part"], days, hours)


def practice(planned: DataFrame, names: DataFrame) -> DataFrame:
    """``plan, day, practice``: what to practise after each study day, by ``names(doc_id, name)``."""
    each = planned.join(names.select("doc_id", "name"), "doc_id").groupBy("plan", "day", "name").agg(F.min(F.struct("position", "topic", "part")).alias("at"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ", ")
    return each.groupBy("plan", "day").agg(F.concat(F.lit("Practise the 2- and 5-mark questions for "), said, F.lit(".")).alias("practice"))


def review_days(planned: DataFrame, by: str, days: int, hours: float = 2.0) -> DataFrame:
    """``by, day, minutes, final, title, practice``: the days after the last study day."""
    last = planned.groupBy(by).agg(F.max("day").alias("last")).where(F.col("last") < days)
    each = last.select(by, F.explode(F.sequence(F.col("last") + 1, F.lit(days))).alias("day"))
    return each.select(by, "day", F.lit(max(10, int(hours * 60 + 0.5) - 30)).alias("minutes"), (F.col("day") == days).alias("final")).withColumns({
        "title": F.when(F.col("final"), "Final revision: read your notes and key terms").otherwise("Revision: re-read your notes"),
        "practice": F.lit("Attempt the 8-mark questions without looking, then check the model answers."),
    })  # fmt: skip  # fixed texts


def totals(planned: DataFrame, by: str) -> DataFrame:
    """``by, days, words, minutes, heaviest_day_words``."""
    per_day = planned.groupBy(by, "day").agg(F.sum("words").alias("w"), F.sum("minutes").alias("m"))
    return per_day.groupBy(by).agg(F.count("*").alias("days"), F.sum("w").alias("words"), F.sum("m").alias("minutes"), F.max("w").alias("heaviest_day_words"))


def progress(planned: DataFrame, checked: DataFrame, by: str, order: str) -> DataFrame:
    """``by, done, items``: how many items of each plan are among ``checked(order)``."""
    ticks = checked.select(order).distinct().withColumn("ticked", F.lit(True))
    return planned.join(ticks, order, "left").groupBy(by).agg(F.count_if("ticked").alias("done"), F.count("*").alias("items"))
