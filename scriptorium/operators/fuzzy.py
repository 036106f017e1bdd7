"""Fuzzy search in a tree of names: spelling slips, word forms, short forms, initials.

Distinct query words meet distinct name words once. Exact, stem and prefix matches are
equi-joins; only slips compare words, and those share a whole part of the query word, so no
cross product of dictionaries arises.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..sources.scratch import settle
from . import tree
from .policy import Policy, readable


def slips(a: str, b: str, most: int = 2) -> int:
    """Edit distance in which a swap of neighbours is one edit and no letter is edited twice; ``most + 1`` beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            d = min(one[j + 1] + 1, row[j] + 1, one[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, two[j - 1] + 1)
            row.append(d)
        if min(row) > most and min(one) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def slip_count(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([slips(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return count(a, b)


def allowed(word: Column) -> Column:
    return F.when(F.length(word) >= 8, 2).when(F.length(word) >= 4, 1).otherwise(0)


def word_matches(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``q, w, score``: how well distinct words ``asked(q)`` match distinct words ``names(w)``."""
    q = asked.select("q", T.stem_search(F.col("q")).alias("sq"), allowed(F.col("q")).alias("slips"), F.col("q").rlike(r"^\d+$").alias("qn"))
    w = names.select("w", T.stem_search(F.col("w")).alias("sw"), F.col("w").rlike(r"^\d+$").alias("wn"))
    exact = q.join(w, F.col("q") == F.col("w")).select("q", "w", F.lit(1.0).alias("score"))
    words, plain = w.where("NOT wn"), q.where("NOT qn")
    stems = plain.join(words, F.col("sq") == F.col("sw")).select("q", "w", F.lit(0.92))
    heads = words.select("*", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.length("w"), F.lit(3))), lambda n: F.substr("w", F.lit(1), n))).alias("head"))
    starts = plain.where(F.length("q") >= 3).join(heads, F.col("q") == F.col("head")).select("q", "w", F.lit(0.8))
    stem_heads = words.select("*", F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.length("sw"), F.lit(4))), lambda n: F.substr("sw", F.lit(1), n))).alias("head"))
    stem_starts = plain.where(F.length("sq") >= 4).join(stem_heads, F.col("sq") == F.col("head")).select("q", "w", F.lit(0.75))

    # a slip touches two neighbouring parts at most (a swap), so one of 2 * slips + 1 parts stays whole
    def near(left: Column, right: Column, floor: float, need: Column) -> DataFrame:
        a = plain.where(need & (F.col("slips") > 0)).select("q", "slips", left.alias("l"))
        n, size = F.length("l"), F.ceil(F.length("l") / (2 * F.col("slips") + 1)).cast("int")
        cut = lambda k: F.substr("l", k * size + 1, F.least(size, F.greatest(n - k * size, F.lit(0))))
        parts = a.select("*", F.explode(F.transform(F.sequence(F.lit(0), 2 * F.col("slips")), cut)).alias("part")).where("part <> ''")
        sizes = F.sequence(F.lit(1), F.least(F.lit(24), F.length("r")))
        grams = words.select("w", right.alias("r")).select(
            "w", "r", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.length("r") - m + 1), lambda i: F.substr("r", i, m)))))).alias("part"),
        )
        pairs = parts.join(grams, "part").where(F.abs(F.length("l") - F.length("r")) <= F.col("slips")).select("q", "w", "l", "r", "slips").distinct()
        return pairs.where(slip_count(F.col("l"), F.col("r")) <= F.col("slips")).select("q", "w", F.lit(floor))

    slipped = near(F.col("q"), F.col("w"), 0.68, F.lit(True))
    stem_slipped = near(F.col("sq"), T.stem_search(F.col("w")), 0.62, F.length("sq") >= 4)
    every = exact.union(stems).union(starts).union(stem_starts).union(slipped).union(stem_slipped)
    return every.groupBy("q", "w").agg(F.max("score").alias("score"))


def expand(query: str) -> list[tuple[str, list[str]]]:
    """A normalised query's words, each with the words of its long form."""
    return [(w, [x for x in W.SHORT_FORMS.get(w, "").split() if x not in W.STOP_WORDS]) for w in query.split() if w not in W.STOP_WORDS]


def search(nodes: DataFrame, query: str, most: int = 60, related: int = 12, policy: Policy | None = None, course: dict[str, str] | None = None) -> DataFrame:
    """``id, name, score, coverage, matched_all, place`` for ``nodes(id, kind, name, parent_id, keywords)``: own words weigh 1,
    those of ancestors 0.7, keywords 0.55. Nodes that match every word come first; where
    fewer than three do, the nearest others follow.

    Under a ``policy``, nodes that the reader may not see are gone before words are matched. Nodes
    of the ``course``, whose columns have the values given, count 1.12 times."""
    spark = nodes.sparkSession
    if policy:
        nodes = settle(nodes.join(readable(nodes, policy), "id", "left_semi"), "readable")
    norm = spark.range(1).select(T.normalize(F.lit(query)).alias("q")).first()["q"]
    terms = expand(norm)
    if not terms:
        return spark.createDataFrame([], "id string, name string, score double, coverage double, matched_all boolean, place int")
    wanted = sorted({w for w, _ in terms} | {x for _, long in terms for x in long})
    asked = spark.createDataFrame([(w,) for w in wanted], "q string")  # the words of one query
    own = nodes.select("id", F.explode(T.search_tokens(F.col("name"))).alias("w"), F.lit(1.0).alias("field"))
    up = tree.closure(nodes).where("depth > 0").join(nodes.select(F.col("id").alias("ancestor"), "name"), "ancestor").select("id", F.explode(T.search_tokens(F.col("name"))).alias("w"), F.lit(0.7).alias("field"))
    inside = nodes.select("id", F.explode(F.flatten(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), T.search_tokens))).alias("w"), F.lit(0.55).alias("field"))
    words = own.unionByName(up).unionByName(inside).groupBy("id", "w").agg(F.max("field").alias("field"))
    # names of ancestors are names of nodes: the dictionary needs no closure
    matches = word_matches(asked, own.select("w").union(inside.select("w")).distinct())
    best = words.join(matches, "w").groupBy("id", "q").agg(F.max(F.col("score") * F.col("field")).alias("m"))
    firsts = nodes.select("id", T.initials(T.search_tokens(F.col("name"))).alias("q")).join(asked.where(F.length("q").between(2, 6)), "q").select("id", "q", F.lit(0.95).alias("m"))
    each = best.unionByName(firsts.select("id", "q", "m")).groupBy("id", "q").agg(F.max("m").alias("m"))
    per_node = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("q", "m"))).alias("m"))
    got = lambda w: F.coalesce(F.try_element_at("m", F.lit(w)), F.lit(0.0))
    values = []
    for word, long in terms:
        value = got(word)
        if long:
            parts = [got(x) for x in long]
            hit = sum(((p >= 0.5).cast("int") for p in parts), F.lit(0)) / F.lit(len(parts))
            value = F.greatest(value, F.when(hit >= 0.6, F.lit(0.9) * sum(parts, F.lit(0.0)) / len(parts) + 0.1).otherwise(0.0))
        values.append(value)
    matched = sum(((v >= 0.5).cast("int") for v in values), F.lit(0))
    here = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string") == str(v), F.lit(False)) for c, v in course.items()]) if course else F.lit(False)
    scored = (
        per_node.select("id", (sum(values, F.lit(0.0)) / len(values)).alias("score"), matched.alias("matched")).where("matched > 0")
        .join(nodes.select("id", "kind", "name", here.alias("here")), "id")
        .withColumn("score", F.round(F.col("score") * F.when(F.col("here"), 1.12).otherwise(1.0) * F.when(F.col("kind") != "file", 1.03).otherwise(1.0), 9))
        .withColumns({"coverage": F.col("matched") / F.lit(len(terms)), "matched_all": F.col("matched") == len(terms)})
    )
    # the first rows in this order hold all of the answer: those related count only where fewer than three match fully
    order = [F.desc("matched_all"), F.when(F.col("matched_all"), 0.0).otherwise(-F.col("coverage")), F.desc("score"), T.natural_key(F.col("name")), F.col("id")]
    first = scored.orderBy(*order).limit(most + related)
    counted = first.withColumn("n", F.count_if("matched_all").over(Window.partitionBy())).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("int"))
    near = F.expr("n < 3 AND coverage >= CASE WHEN n > 0 THEN 0.5 ELSE 0.3 END") & (F.col("place") - F.col("n") <= related)
    return counted.where(F.when(F.col("matched_all"), F.col("place") <= most).otherwise(near)).select("id", "name", "score", "coverage", "matched_all", "place")
