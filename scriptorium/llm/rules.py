"""Quality rules: fixed limits on document statistics, and boosted trees over more of them.

``statistics`` counts a document's words, symbols, repeated lines and repeated word windows
exactly, over whole texts, beside shares that only the trees use. Two rules are fixed: fewer
than 50 words, or more than half of the words in 3-word windows that occur twice, fail.

What passes is judged by gradient-boosted trees (logistic loss, second-order gains over
histograms, equal depth). Some statistics may only lower the verdict: of a split on such a
one the side of higher values never gets the higher weight, and the middle of the two
weights bounds all that is below either side, so that the whole score never rises with it.
Trees are flattened into arrays of features, thresholds and leaf values, in which all rows
and all trees walk a level at a time. That model is a few thousand numbers at any size of
corpus. It learns from a bounded sample of labelled rows (``sample_docs``, drawn by a hash
of doc_id, whole texts); statistics and verdicts cover every row.

Nulls and ties: a null or empty text has no words and fails; a null doc_id is never
labelled or held out; a document labelled more than once takes its largest label, null
labels are ignored; without usable labels every score is 0.5 and only the fixed rules
decide; equal gains go to the first statistic and the lowest threshold; repeated rows are
judged alike. Further columns are ignored, and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import prepare
from .toxicity import held_out, labelled_sample

LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SAMPLE_DOCS = 20_000
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"
ENDS = b".,;:!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the trees, and in which direction (-1: down only) they may move the score.
SHARES = {
    "log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "top_word": -1, "distinct_words": 0, "upper": 0, "exclamations": -1, "digits": 0,
    "marks": 0, "far_letters": 0, "short_words": 0, "long_words": 0, "capital_words": 0, "ended_words": 0, "words_a_line": 0, "byte_entropy": 0,
}

CASED = K._table(False)
LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True


def _bytes(*spans) -> np.ndarray:
    found = np.zeros(256, bool)
    for s in spans:
        found[list(s)] = True
    return found


UPPER, LOWER, DIGIT = _bytes(range(0x41, 0x5B)), _bytes(range(0x61, 0x7B)), _bytes(range(0x30, 0x3A))
CONTINUED, LEADS = _bytes(range(0x80, 0xC0)), _bytes(range(0xC0, 0x100))
SYMBOL, MARK = _bytes(SYMBOLS), _bytes(ENDS, b"'\"()-")


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """How many words lie in a window of ``n`` that occurs at least twice."""
    if len(words) < n:
        return 0
    _, which, count = np.unique(K.shingle_hashes(words, n), return_inverse=True, return_counts=True)
    twice, inside = count[which] > 1, np.zeros(len(words), bool)
    for k in range(n):
        inside[k : len(words) - n + 1 + k] |= twice
    return int(inside.sum())


def statistics(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``COUNTS`` and ``SHARES`` of each document, by some documents at a time."""
    for c in K.chunks(column):
        starts, ends, at = c.spans()
        words = c.hashes(starts, ends, CASED)
        line_starts, line_ends, line_at = c.spans(LINE_END)
        lines = c.hashes(line_starts, line_ends, CASED)
        worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
        by_byte = np.stack([np.bincount(c.data[a:b], minlength=256) for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True)])
        n = np.diff(at)
        counts, shares = np.zeros((c.n, len(COUNTS)), np.int64), np.zeros((c.n, len(SHARES)))
        counts[:, 0] = n
        counts[:, 1] = by_byte[:, ~K.SPACE & ~CONTINUED].sum(axis=1)
        counts[:, 2] = by_byte[:, SYMBOL].sum(axis=1)
        n_lines, distinct, top = np.zeros(c.n, np.int64), np.zeros(c.n, np.int64), np.zeros(c.n, np.int64)
        for i in range(c.n):
            own = lines[line_at[i] : line_at[i + 1]][worded[line_at[i] : line_at[i + 1]]]
            n_lines[i] = len(own)
            counts[i, 3] = len(own) - len(np.unique(own))
            said = words[at[i] : at[i + 1]]
            counts[i, 4] = repeated_words(said)
            if len(said):
                _, often = np.unique(said, return_counts=True)
                distinct[i], top[i] = len(often), often.max()

        def of_words(which: np.ndarray, at=at) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(which)])
            return upto[at[1:]] - upto[at[:-1]]

        length = ends - starts
        some, chars = np.maximum(n, 1), np.maximum(counts[:, 1], 1)
        letters = np.maximum(by_byte[:, UPPER | LOWER | LEADS].sum(axis=1), 1)
        total = np.maximum(by_byte.sum(axis=1), 1)
        p = by_byte / total[:, None]
        values = [
            np.log1p(n), counts[:, 1] / some, counts[:, 2] / chars, counts[:, 3] / np.maximum(n_lines, 1), counts[:, 4] / some, top / some, distinct / some,
            by_byte[:, UPPER].sum(axis=1) / letters, by_byte[:, ord("!")] / some, by_byte[:, DIGIT].sum(axis=1) / chars, by_byte[:, MARK].sum(axis=1) / chars,
            by_byte[:, LEADS].sum(axis=1) / letters, of_words(length <= 3) / some, of_words(length >= 20) / some,
            of_words(UPPER[c.data[starts]]) / some, of_words(_bytes(ENDS)[c.data[ends - 1]]) / some, np.log1p(n / np.maximum(n_lines, 1)),
            -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1),
        ]
        shares[:] = np.stack(values, axis=1)
        yield counts, shares


class Trees(NamedTuple):
    """Flattened trees of equal depth: node k of a tree has its children at 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # rows of at most this go to the first child
    value: np.ndarray  # trees x leaves
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, every = np.arange(len(x))[:, None], np.arange(trees)
        node = np.zeros((len(x), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[every, node]] > self.threshold[every, node])
        return self.base + self.value[every, node - inner].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, toward: tuple[int, ...], trees=60, depth=4, rate=0.2, l2=1.0, bins=64) -> Trees:
    """Boosted trees for P(y = 1); ``toward`` has for each column 1 (may only raise), -1 (only lower) or 0."""
    n, columns, inner = len(x), x.shape[1], (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    share = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    if not n or not columns:
        return Trees(feature, threshold, value, base if n else 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    score = np.full(n, base)
    best_weight = lambda g, h, low, high: np.clip(-g / (h + l2), low, high)
    saves = lambda g, h, w: -(g * w + 0.5 * (h + l2) * w * w)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node, first = np.zeros(n, np.int64), 0  # first: of the level's nodes
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            width = 1 << level
            total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
            whole = saves(total_g, total_h, best_weight(total_g, total_h, low, high))
            gain, chosen, place = np.full(width, 1e-9), np.full(width, -1), np.zeros(width, np.int64)
            left_w, right_w = np.zeros(width), np.zeros(width)
            for f, e in enumerate(edges):
                m = len(e) + 1
                key = node * m + binned[:, f]
                gl, hl = (np.bincount(key, v, width * m).reshape(width, m).cumsum(axis=1)[:, :-1] for v in (g, h))
                if m == 1:
                    continue
                gr, hr, lo, hi = total_g[:, None] - gl, total_h[:, None] - hl, low[:, None], high[:, None]
                wl, wr = best_weight(gl, hl, lo, hi), best_weight(gr, hr, lo, hi)
                won = saves(gl, hl, wl) + saves(gr, hr, wr) - whole[:, None]
                won[(hl < 1e-3) | (hr < 1e-3) | (toward[f] * (wr - wl) < 0)] = -np.inf
                k = won.argmax(axis=1)
                more = won[np.arange(width), k] > gain
                gain[more], chosen[more], place[more] = won[more, k[more]], f, k[more]
                left_w[more], right_w[more] = wl[more, k[more]], wr[more, k[more]]
            new_low, new_high = np.repeat(low, 2), np.repeat(high, 2)
            for j in np.flatnonzero(chosen >= 0):
                f = chosen[j]
                feature[t, first + j], threshold[t, first + j] = f, edges[f][place[j]]
                if toward[f]:
                    middle = (left_w[j] + right_w[j]) / 2
                    above, below = (2 * j, 2 * j + 1) if toward[f] < 0 else (2 * j + 1, 2 * j)
                    new_low[above], new_high[below] = max(low[j], middle), min(high[j], middle)
            f, cut = feature[t, first + node], threshold[t, first + node]
            node = 2 * node + (x[np.arange(n), f] > cut)
            low, high, first = new_low, new_high, first + width
        leaf_g, leaf_h = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        value[t] = rate * np.clip(-leaf_g / (leaf_h + l2), low, high)
        score += value[t][node]
    return Trees(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Trees | None:
    """The model, or None without usable labels. One task holds the sample's statistics."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", 5, 0, sample_docs)

    def measure(batches):
        for b in batches:
            shares = np.concatenate([np.zeros((0, len(SHARES))), *(s for _, s in statistics(b["text"]))])
            yield pa.RecordBatch.from_arrays([b["rank"], b["y"], pa.array(list(shares), pa.list_(pa.float64()))], ["rank", "y", "x"])

    def learn(batches):
        rows = [r for b in batches for r in zip(b["rank"].to_pylist(), b["y"].to_pylist(), b["x"].to_pylist(), strict=True)]
        if rows:
            rows.sort()
            model = boost(np.array([x for _, _, x in rows]), np.array([y for _, y, _ in rows], float), tuple(SHARES.values()))
            parts = [pa.array([part.ravel().tolist()]) for part in model[:3]]
            yield pa.RecordBatch.from_arrays([*parts, pa.array([model.base]), pa.array([len(model.feature)])], ["feature", "threshold", "value", "base", "trees"])

    rows = sample.select(F.xxhash64("doc_id", "text").alias("rank"), "y", "text").mapInArrow(measure, "rank long, y int, x array<double>")
    found = rows.repartition(1).mapInArrow(learn, "feature array<long>, threshold array<double>, value array<double>, base double, trees long").first()
    if found is None:
        return None
    shaped = [np.array(found[k]).reshape(found["trees"], -1) for k in ("feature", "threshold", "value")]
    return Trees(*shaped, found["base"])


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    """What the fixed rules refuse."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judged(docs: DataFrame, model: Trees | None) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, score (0 to 1), and all shares by name."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees x nodes, at any size of corpus

    def go(batches):
        for b in batches:
            counts, shares = (np.concatenate(x) for x in zip((np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(SHARES)))), *statistics(b["text"]), strict=True))
            score = 1 / (1 + np.exp(-np.clip(sent.value.logits(shares), -35, 35))) if sent.value else np.full(len(shares), 0.5)
            columns = [b["doc_id"], *(pa.array(v) for v in counts.T), pa.array(score), *(pa.array(v) for v in shares.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "score", *SHARES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS), "score double", *(f"{c} double" for c in SHARES)])
    return docs.select("doc_id", "text").mapInArrow(go, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, held_out, score."""
    found = judged(docs, train(docs, labels, sample_docs)).withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    return found.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score")
