"""Ordered folds: chunks, parts, pages, day groups, transcripts.

Each fold carries a small state along the items of one document. Only numbers (word
counts, lengths, flags) go to Python, in Arrow batches, and a fold is linear in its items;
the texts stay in the JVM and are put together there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counts import spans_of


def chunk_numbers(counts, target: int = 180, overlap: int = 1) -> list[int]:
    """The chunk of each sentence by its word count; the last ``overlap`` sentences of a
    chunk also open the next one and count there."""
    out, chunk, words, fresh = [], 0, 0, 0
    for i, w in enumerate(counts):
        if fresh and words + w > target:
            chunk += 1
            words, fresh = sum(counts[max(0, i - overlap) : i]), 0
        out.append(chunk)
        words += w
        fresh += 1
    return out


def part_numbers(sizes, most: int = 300_000) -> list[int]:
    """Items in order into parts of at most ``most``; a larger item is a part by itself."""
    out, part, size = [], 0, 0
    for i, n in enumerate(sizes):
        if size + n > most and i and size >= 0 and out and out[-1] == part:
            part, size = part + 1, 0
        out.append(part)
        size += n
    return out


def page_numbers(blocks, words: int = 450) -> list[int]:
    """Blocks ``(words, is heading)`` into pages: a page closes when it would pass ``words``,
    or before a heading once it is more than 60 % full."""
    out, page, count = [], 0, 0
    for n, heading in blocks:
        if count and (count + n > words or (heading and count > words * 0.6)):
            page, count = page + 1, 0
        out.append(page)
        count += n
    return out


def day_numbers(weights, days: int) -> list[int]:
    """Topics in order onto days of about equal weight; no day stays without a topic."""
    total, days = sum(weights), min(days, len(weights))
    out, day, load, held = [], 0, 0.0, 0
    for i, w in enumerate(weights):
        left, days_left = len(weights) - i, days - day - 1
        if held and days_left > 0 and (load + w / 2 > total / days or left == days_left):
            day, load, held = day + 1, 0.0, 0
        out.append(day)
        load += w
        held += 1
    return out


def _fold(step, kind: str = "array<int>"):
    @F.pandas_udf(kind)
    def run(items: pd.Series) -> pd.Series:
        return items.map(lambda x: step([] if x is None else list(x)))

    return run


def chunk_spans(counts, target: int = 180, overlap: int = 1) -> list[tuple[int, int]]:
    """Where each chunk of ``chunk_numbers`` begins, counted from 0 and with its overlap, and how many sentences it holds."""
    numbers = chunk_numbers(counts, target, overlap)
    starts = [i for i, c in enumerate(numbers) if not i or c != numbers[i - 1]]
    begins = [max(0, i - overlap) for i in starts]
    return [(a, b - a) for a, b in zip(begins, [*starts[1:], len(numbers)], strict=False)]


def chunk_fold(target: int = 180, overlap: int = 1):
    return spans_of(lambda counts: chunk_spans(counts, target, overlap), ("first", "n"))


def part_fold(most: int = 300_000):
    return _fold(lambda sizes: part_numbers(sizes, most))


def page_fold(words: int = 450):
    return _fold(lambda blocks: page_numbers([(b["words"], b["heading"]) for b in blocks], words))


def day_fold(days: int):
    return _fold(lambda weights: day_numbers(weights, days))


def chunks(pages: DataFrame, target: int = 180, overlap: int = 1) -> DataFrame:
    """``doc_id, chunk_id, page, first_sentence, sentences, words, text`` of
    ``pages(doc_id, page, text)``; ids are dense within a document."""
    split = pages.select("doc_id", "page", T.split_sentences(F.col("text")).alias("s"))
    counted = split.withColumn("n", F.transform("s", lambda x: T.word_count(x).cast("int")))
    placed = counted.withColumn("c", chunk_fold(target, overlap)("n"))  # without a filter, which would part the texts once more

    def made(x: Column, c: Column) -> Column:
        body = F.array_join(F.slice("s", x["first"] + 1, x["n"]), "\n")
        return F.struct(c.alias("c"), x["first"].alias("first_sentence"), x["n"].alias("sentences"), body.alias("text"))

    each = placed.select("doc_id", "page", F.explode_outer(F.transform("c", made)).alias("m")).where("m IS NOT NULL")
    before = F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY page, m.c)") - 1
    return each.select(
        "doc_id", before.cast("int").alias("chunk_id"), "page", "m.first_sentence", "m.sentences", T.word_count(F.col("m.text")).alias("words"), F.col("m.text").alias("text")
    )


def parts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """``doc_id, part, items, size`` of each document's lines filled in order into parts of at most ``most`` characters."""
    sized = docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x)).alias("n"))
    zipped = sized.select("doc_id", F.explode(F.arrays_zip(F.col("n").alias("n"), part_fold(most)("n").alias("p"))).alias("x"))
    return zipped.groupBy("doc_id", F.col("x.p").alias("part")).agg(F.count("*").alias("items"), F.sum("x.n").cast("long").alias("size"))


def context_pack(pages: DataFrame, budget: int) -> DataFrame:
    """``doc_id, page, n_chars``: a document's pages from the front while they fit the
    budget; packing stops at the first that doesn't."""
    from pyspark.sql import Window

    size = F.length(T.strip(F.coalesce("text", F.lit(""))))
    per = Window.partitionBy("doc_id").orderBy("page")
    run = pages.withColumn("n_chars", size).withColumn("total", F.sum("n_chars").over(per))
    return run.withColumn("over", F.max((F.col("total") > budget).cast("int")).over(per)).where("over = 0").select("doc_id", "page", F.col("n_chars").cast("long").alias("n_chars"))


def join_recognition(results: Column) -> Column:
    """One transcript of a recogniser's results in order: an extension replaces what it
    extends, and a repeat of an ending is dropped. A session has few results."""

    def step(done: Column, raw: Column) -> Column:
        x = T.strip(F.coalesce(raw, F.lit("")))
        last = F.lower(F.coalesce(F.get(done, F.size(done) - 1), F.lit("")))
        some = F.size(done) > 0
        return (
            F.when(x == "", done)
            .when(some & F.startswith(F.lower(x), last), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), x))
            .when(some & F.endswith(last, F.lower(x)), done)
            .otherwise(F.array_append(done, x))
        )

    return T.squash(F.array_join(F.aggregate(results, F.array().cast("array<string>"), step), " "))


def topic_parts(words, target: float) -> list[int]:
    """The part of each page of a topic: a part closes at 80 % of ``target``; a tail below 30 %
    of it joins the part before. A topic up to a quarter over the target stays whole."""
    if sum(words) <= target * 1.25 or len(words) < 2:
        return [0] * len(words)
    out, part, load = [], 0, 0
    for w in words:
        out.append(part)
        load += w
        if load >= target * 0.8:
            part, load = part + 1, 0
    if load and out[-1] and load < target * 0.3:
        out = [min(p, out[-1] - 1) for p in out]
    return out


def topic_fold(target: float):
    return _fold(lambda words: topic_parts(words, target))
