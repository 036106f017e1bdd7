"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased in A-Z. A document's features are the
*distinct* hashes of its single words, word pairs, and pairs that skip one or two words;
each present feature weighs 1. Per-coordinate learning rates and the L1 term leave a few
hundred non-zero weights, so what is broadcast is bounded by ``2**bits`` at any size of
corpus. Errors on toxic documents, which are few, count three times.

Training reads a bounded sample of labelled rows (``sample_docs``, drawn by a hash of
doc_id), whole texts; it is dealt to a fixed number of learners (one here: it learned better
than the mean of two), whose weights are averaged. Scoring covers every row.

Nulls and ties: a null or empty text has no features and gets the bias alone; a null
doc_id is never labelled or held out; a document labelled more than once is toxic if any
of its labels is; null labels are ignored; without usable labels every score is 0.5.
Further columns of either input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import prepare

BITS = 20
SAMPLE_DOCS = 24_000
LEARNERS = 1
THRESHOLD = 0.7


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def feature_sets(column: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each document of an Arrow column."""
    shift, salt = K.U(64 - bits), [K.U(0), K.U(0x51ED270B), K.U(0x2545F491), K.U(0x7F4A7C15)]
    for c in K.chunks(column):
        starts, ends, at = c.spans(K.PUNCT)
        h = c.hashes(starts, ends)
        grams = [K.mix(h) >> shift]
        for gap in (1, 2, 3):
            grams.append(K.mix(h[:-gap] * K.U(31) + h[gap:] * K.U(0x9E3779B97F4A7C15) + salt[gap]) >> shift)
        for i in range(c.n):
            a, b = at[i], at[i + 1]
            parts = [g[a : max(a, b - gap)] for gap, g in enumerate(grams)]
            yield np.unique(np.concatenate(parts)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha=2.0, beta=1.0, l1=16.0, l2=0.0, epochs=5, positive=3.0) -> tuple[np.ndarray, float]:
    """FTRL-proximal over ``(feature numbers, label)`` rows; returns weights and bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w, wb = weight(zx, nx, l1), float(weight(np.float64(zb), np.float64(nb), 0.0))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = (p - y) * (positive if y else 1.0)
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    return weight(z, n, l1), float(weight(np.float64(zb), np.float64(nb), 0.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, most: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most about ``most`` labelled rows that aren't held out."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .where(~held_out(F.col("doc_id"), mod, rest))
    )
    share = min(1.0, most / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about `most` rows of two numbers: bounded, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_docs: int = SAMPLE_DOCS, learners: int = LEARNERS) -> tuple[np.ndarray, float]:
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", 3, 1, sample_docs)

    def featurize(batches):
        for b in batches:
            sets = list(feature_sets(b["text"], bits))
            yield pa.RecordBatch.from_arrays(
                [b["learner"], b["rank"], b["y"], pa.array(sets, pa.list_(pa.int32()))], ["learner", "rank", "y", "x"]
            )

    def learn(batches):
        rows = [
            (r, x.values.to_numpy(zero_copy_only=False), y)
            for b in batches
            for r, x, y in zip(b["rank"].to_pylist(), b["x"], b["y"].to_pylist(), strict=True)
        ]
        rows.sort(key=lambda r: r[0])
        if rows:
            w, bias = ftrl([r[1:] for r in rows], bits)
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, -1), pa.int64()), pa.array(np.append(w[i], bias), pa.float64())], ["i", "w"]
            )

    rows = sample.select(
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(learners)).cast("int").alias("learner"),
        F.xxhash64("doc_id", "text").alias("rank"), "y", "text",
    ).mapInArrow(featurize, "learner int, rank long, y int, x array<int>")
    # a learner's share of the bounded sample, not of the corpus, is what one task holds
    parts = rows.repartition(learners, "learner").mapInArrow(learn, "i long, w double")
    found = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("k")).collect()  # at most 2**bits + 1 rows
    w, bias = np.zeros(1 << bits, np.float32), 0.0
    n = max([r["k"] for r in found if r["i"] == -1], default=1)
    for r in found:
        if r["i"] < 0:
            bias = r["w"] / n
        else:
            w[r["i"]] = r["w"] / n
    return w, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, name: str = "score") -> DataFrame:
    """``docs`` with a new column ``name``: every row, whole texts."""
    w, bias = model
    keep = np.flatnonzero(w).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((keep, w[keep], bias))
    cols = docs.columns
    out = docs.withColumn(name, F.lit(0.0)).schema

    def go(batches):
        i, v, b0 = sent.value
        table = np.zeros(1 << bits, np.float32)
        table[i] = v
        for b in batches:
            s = np.array([table[x].sum(dtype=np.float64) for x in feature_sets(b["text"], bits)]) + b0
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*cols, name])

    return docs.mapInArrow(go, out)


def clean(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted to be toxic; columns stay."""
    own = "__toxicity"
    while own in docs.columns:
        own += "_"
    scored = score(docs, train(docs, labels, bits, sample_docs), bits, own)
    return scored.where(F.col(own) < threshold).select(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels, bits, sample_docs)
    return score(docs.select("doc_id", "text"), model, bits).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
