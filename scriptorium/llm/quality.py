"""Quality classifier: supervised subword embeddings, trained by numpy SGD.

A document is the mean of learned vectors of its hashed parts: words, neighbouring word
pairs (hashed by the difference of the two words, so that every immediate repetition is
one part), and runs of 3 to 5 bytes that hold no inner white space. A softmax layer turns
the mean into class probabilities. As the mean and the layer are both linear, scoring
folds the trained vectors into one number a bucket, which is the same model.

Training reads a bounded sample of labelled rows (``sample_docs``, drawn by a hash of
doc_id), whole texts; scoring covers every row and whole texts.

Nulls and ties: a null or empty text has no parts and gets the layer's bias; a null doc_id
is never labelled or held out; a document labelled more than once takes its largest label;
null labels are ignored; without usable labels every score is 0.5. Further columns of
either input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import prepare
from .toxicity import held_out, labelled_sample

BITS = 19
DIM = 8
SAMPLE_DOCS = 6_000
THRESHOLD = 0.3
GRAMS = (3, 4, 5)


def parts(column: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The bucket numbers of each document's parts, repeats included."""
    shift = K.U(64 - bits)
    for c in K.chunks(column):
        starts, ends, at = c.spans()
        h = c.hashes(starts, ends)
        single = K.mix(h + K.U(1)) >> shift
        pair = K.mix((h[1:] - h[:-1]) * K.U(0x9E3779B97F4A7C15) + K.U(2)) >> shift
        n = len(c.data)
        s, (_, inv) = c.prefix(), K._powers(n + 1)
        gaps = np.zeros(n + 1, np.int32)
        np.cumsum(K.SPACE[c.data], out=gaps[1:])
        grams = []
        for k in GRAMS:
            m = max(0, n - k + 1)
            inner_free = gaps[k - 1 : k - 1 + m] == gaps[1 : 1 + m]
            place = np.flatnonzero(inner_free)
            v = K.mix((s[place + k] - s[place]) * inv[place] + K.U(k)) >> shift
            grams.append((k, place, v.astype(np.int32)))
        single, pair = single.astype(np.int32), pair.astype(np.int32)
        for i in range(c.n):
            a, b = at[i], at[i + 1]
            lo, hi = c.bounds[i], c.bounds[i + 1]
            own = [single[a:b], pair[a : max(a, b - 1)]]
            for k, place, v in grams:
                p, q = np.searchsorted(place, (lo, hi - k + 1))
                own.append(v[p : max(p, q)])
            yield np.concatenate(own)


def sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = DIM, rate=2.0, epochs=4, seed=7) -> tuple[np.ndarray, float]:
    """Train on ``(buckets, counts, label)`` rows; returns each bucket's logit and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, t = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x, c, y = rows[k]
            lr = rate * (1 - t / steps)
            t += 1
            total = c.sum()
            if not total:
                continue
            mean = c @ table[x] / total
            e = mean @ layer + bias
            p = np.exp(e - e.max())
            p /= p.sum()
            g = p
            g[y] -= 1
            back = layer @ g
            layer -= lr * np.outer(mean, g)
            bias -= 0.1 * lr * g
            table[x] -= np.outer(c * (lr / total), back).astype(np.float32)
    return table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", 5, 0, sample_docs)

    def featurize(batches):
        for b in batches:
            found = [np.unique(x, return_counts=True) for x in parts(b["text"], bits)]
            yield pa.RecordBatch.from_arrays(
                [b["rank"], b["y"], pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.float32) for _, c in found], pa.list_(pa.float32()))],
                ["rank", "y", "x", "c"],
            )

    def learn(batches):
        rows = [
            (r, x.values.to_numpy(), c.values.to_numpy(), y)
            for b in batches
            for r, x, c, y in zip(b["rank"].to_pylist(), b["x"], b["c"], b["y"].to_pylist(), strict=True)
        ]
        rows.sort(key=lambda r: r[0])
        if rows:
            logits, bias = sgd([r[1:] for r in rows], bits)
            yield pa.RecordBatch.from_arrays([pa.array([logits.astype(np.float32).tobytes()]), pa.array([bias])], ["logits", "bias"])

    rows = sample.select(F.xxhash64("doc_id", "text").alias("rank"), "y", "text").mapInArrow(featurize, "rank long, y int, x array<int>, c array<float>")
    # one learner holds the bounded sample, whatever the size of the corpus
    found = rows.repartition(1).mapInArrow(learn, "logits binary, bias double").first()
    if found is None:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(found["logits"], np.float32), found["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """``docs`` with a column ``score``: every row, whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats at any size of corpus
    cols, out = docs.columns, docs.withColumn("score", F.lit(0.0)).schema

    def go(batches):
        logits, bias = sent.value
        for b in batches:
            s = np.array([logits[x].mean(dtype=np.float64) if len(x) else 0.0 for x in parts(b["text"], bits)]) + bias
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*cols, "score"])

    return docs.mapInArrow(go, out)


def quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels, bits, sample_docs)
    return score(docs.select("doc_id", "text"), model, bits).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
