"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Words are runs of letters and digits, lower-cased in A-Z. A window has as many words as an
item (or is the whole document, where that is shorter) and is described by its runs of
five words, as the item is (fewer words: all of them as one run). For every place at which
a document could hold an item:

1. a window that shares no run with any item of its length has similarity 0 and is passed
   over, which loses nothing;
2. the others get a 64-bit SimHash of their runs, taken from running lane sums;
3. eight blocks of eight bits index the items' fingerprints: two fingerprints within
   ``radius`` agree in some block up to ``radius // 8`` bits, so looking up every block
   value with its neighbours finds all items within the radius;
4. candidates are verified exactly: the sum of weights of common runs over that of all
   runs, as multisets, at least ``similarity``. A run weighs ``ln(1 + items / items that
   have it)``, over the whole benchmark; one that no item has counts as had by one.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of its text (and one item)
and ``BLOCK_ITEMS`` items, one pass over the documents a block; of several, each one's
result is written and the block dropped before the next is sent, so the benchmark's size is
not bounded by memory. Of several blocks each gets the counts of its own runs by a join, and by a further pass over the
documents those of the other blocks' runs in windows that could be leaks; both passes find
the same as one block would.

Nulls and ties: a null or empty text leaks nothing; items without words are left out; a
null doc_id or item_id is kept; repeated rows are reported each; of equally similar windows
of an item in a document the first is reported. Further columns are ignored by ``leaks``
and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import prepare, settle

RUN, SIMILARITY, RADIUS = 5, 0.8, 20
#: A block holds about so much text and so many items at most: a few tens of MB of runs, weights and index lists when sent.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 32_768
STRETCH = 50_000  # windows fingerprinted at once


def simhash(runs: np.ndarray, width: int) -> np.ndarray:
    """64-bit SimHash of each window of ``width`` neighbouring runs."""
    lanes = np.unpackbits(runs.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(runs) + 1, 64), np.int32)
    np.cumsum(lanes, axis=0, out=sums[1:])
    return np.packbits(sums[width:] > sums[:-width], axis=1).view(np.uint64).ravel()


class HammingIndex:
    """Multi-index over 64-bit fingerprints: every one within ``radius`` is found."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        values = np.arange(256)
        near = np.bitwise_count((values[:, None] ^ values[None, :]).astype(np.uint8)) <= radius // 8
        blocks = prints.view(np.uint8).reshape(-1, 8)
        self.lists = [[np.flatnonzero(near[v, blocks[:, b]]).astype(np.int32) for v in range(256)] for b in range(8)]

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, item)`` numbers of all pairs within the radius."""
        at = queries.view(np.uint8).reshape(-1, 8)
        found = []
        for b, lists in enumerate(self.lists):
            for v in np.unique(at[:, b]):
                q, i = np.flatnonzero(at[:, b] == v), lists[v]
                if len(i):
                    found.append(np.repeat(q, len(i)) * len(self.prints) + np.tile(i, len(q)).astype(np.int64))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        q, i = pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))
        ok = np.bitwise_count(queries[q] ^ self.prints[i]) <= self.radius
        return q[ok], i[ok]


class Items:
    """A block of the benchmark, made ready: runs by length class, weights, indexes. A block
    that isn't the whole benchmark is told how many ``items`` that has, and gets its weights
    by ``weigh``."""

    def __init__(self, texts: list[str | None], radius: int = RADIUS, items: int | None = None):
        self.runs: list[np.ndarray] = []
        self.words: list[int] = []
        for c in K.chunks(pa.array(texts, pa.string())):
            starts, ends, at = c.spans(K.PUNCT)
            h = c.hashes(starts, ends)
            for i in range(c.n):
                self.words.append(int(at[i + 1] - at[i]))
                self.runs.append(K.document_shingles(h[at[i] : at[i + 1]], RUN))
        self.items = len(texts) if items is None else items
        self.rarest = float(np.log1p(self.items))
        self.weight: dict[int, float] = {}
        if items is None:
            had: dict[int, int] = {}
            for r in self.runs:
                for x in set(r.tolist()):
                    had[x] = had.get(x, 0) + 1
            self.weigh(had)
        self.by_words: dict[int, np.ndarray] = {}
        for w in sorted({w for w in self.words if w}):
            self.by_words[w] = np.array([i for i, x in enumerate(self.words) if x == w])
        self.known = {w: np.unique(np.concatenate([self.runs[i] for i in own])) for w, own in self.by_words.items()}
        self.index = {w: HammingIndex(np.concatenate([simhash(self.runs[i], len(self.runs[i])) for i in own]), radius) for w, own in self.by_words.items()}
        self.length_of_run = {n: np.unique(np.concatenate([self.known[w] for w in self.by_words if min(w, RUN) == n])) for n in {min(w, RUN) for w in self.by_words}}
        self.quick = {}
        for n, runs in self.length_of_run.items():
            table = np.zeros(1 << 16, bool)
            table[(runs & K.U(0xFFFF)).astype(np.int64)] = True
            self.quick[n] = table

    def weigh(self, had: dict[int, int]) -> None:
        """``had``: by how many items of the benchmark a run is had (not given: by one)."""
        self.weight |= {x: float(np.log1p(self.items / n)) for x, n in had.items()}

    def own(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, K.U), *self.runs]))

    def similarity(self, window: np.ndarray, item: int) -> float:
        values, which = np.unique(np.concatenate([window, self.runs[item]]), return_inverse=True)
        a = np.bincount(which[: len(window)], minlength=len(values))
        b = np.bincount(which[len(window) :], minlength=len(values))
        w = np.array([self.weight.get(x, self.rarest) for x in values.tolist()])
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def strangers(self, column: pa.Array, similarity: float, own: np.ndarray) -> np.ndarray:
        """Runs that are not the block's (``own``), of windows that reach ``similarity`` where
        these weigh as little as a run can: ``ln 2``, had by all items."""
        found = [np.zeros(0, K.U)]
        for document in self._documents(column):
            for _, _, item, window in self._candidates(*document) if document else ():
                values, which = np.unique(np.concatenate([window, self.runs[item]]), return_inverse=True)
                a = np.bincount(which[: len(window)], minlength=len(values))
                b = np.bincount(which[len(window) :], minlength=len(values))
                strange = ~np.isin(values, own)
                w = np.where(strange, np.log(2), [self.weight.get(x, self.rarest) for x in values.tolist()])
                if strange.any() and (np.minimum(a, b) * w).sum() >= (similarity - 1e-9) * (np.maximum(a, b) * w).sum():
                    found.append(values[strange])
        return np.unique(np.concatenate(found))

    def leaks(self, column: pa.Array, similarity: float) -> Iterator[list[tuple[int, int, int, float]]]:
        """For each document: ``(item, first word, words, similarity)``, the best window an item."""
        for document in self._documents(column):
            best: dict[int, tuple[float, int, int]] = {}
            for p, n, item, window in self._candidates(*document) if document else ():
                score = self.similarity(window, item)
                if score >= similarity and (item not in best or score > best[item][0]):
                    best[item] = (score, p, n)
            yield [(item, p, n, score) for item, (score, p, n) in sorted(best.items())]

    def _documents(self, column: pa.Array) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray]] | None]:
        """For each document its words and the places of known runs; None where it has none."""
        for c in K.chunks(column):
            starts, ends, at = c.spans(K.PUNCT)
            h = c.hashes(starts, ends)
            places = {}
            for n, table in self.quick.items():
                r = K.shingle_hashes(h, n)
                p = np.flatnonzero(table[(r & K.U(0xFFFF)).astype(np.int64)])
                known = self.length_of_run[n]
                j = np.minimum(np.searchsorted(known, r[p]), len(known) - 1)
                places[n] = p[known[j] == r[p]]
            for i in range(c.n):
                a, b = int(at[i]), int(at[i + 1])
                near = {n: p[slice(*np.searchsorted(p, (a, b - n + 1)))] - a for n, p in places.items()}
                short = b - a < RUN and b > a and RUN in self.quick
                yield (h[a:b], near) if short or any(map(len, near.values())) else None

    def _candidates(self, words: np.ndarray, near: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """``(first word, words, item, runs of the window)`` of all pairs within the radius."""
        made: dict[int, np.ndarray] = {}
        for w, own in self.by_words.items():
            n = min(w, RUN, len(words))
            if n < min(w, RUN):
                continue  # a text of fewer words is one run that no longer item has
            width = min(w, len(words)) - n + 1
            if n not in made:
                made[n] = K.shingle_hashes(words, n)
            runs, hits = made[n], near[n]
            if not len(hits):
                continue
            hits = hits[np.isin(runs[hits], self.known[w])]
            last = len(runs) - width
            covered = np.zeros(last + 2, np.int64)
            np.add.at(covered, np.clip(hits - width + 1, 0, last), 1)
            np.add.at(covered, np.minimum(hits, last) + 1, -1)
            windows = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            breaks = np.flatnonzero((np.diff(windows) > 1)) + 1
            for stretch in np.split(windows, breaks):
                for k in range(0, len(stretch), STRETCH):
                    s = stretch[k : k + STRETCH]
                    if not len(s):
                        continue
                    prints = simhash(runs[s[0] : s[-1] + width], width)
                    for q, i in zip(*self.index[w].find(prints), strict=True):
                        p, item = int(s[0] + q), int(own[i])
                        yield p, min(w, len(words)), item, runs[p : p + width]


def blocks(items: DataFrame) -> Iterator[list]:
    """The benchmark's rows in blocks of bounded size, streamed through the driver."""
    held, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append(r)
        size += len(r["text"] or "")
        if size >= BLOCK_BYTES or len(held) >= BLOCK_ITEMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def shared_runs(items: DataFrame) -> DataFrame:
    """``run, n``: runs that several items have, and how many."""

    def go(batches):
        for b in batches:
            for c in K.chunks(b["text"]):
                h, at = c.hashes(*(s := c.spans(K.PUNCT))[:2]), s[2]
                runs = [np.unique(K.document_shingles(h[at[i] : at[i + 1]], RUN)) for i in range(c.n)]
                yield _run_batch(np.concatenate(runs))

    return items.select("text").mapInArrow(go, "run long").groupBy("run").agg(F.count("*").alias("n")).where("n > 1")


def _run_batch(runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64))], ["run"])


def _had(counts: DataFrame, runs: DataFrame) -> dict[int, int]:
    found = counts.join(runs, "run").select("run", "n").toArrow()
    return dict(zip(found["run"].to_numpy().view(np.uint64).tolist(), found["n"].to_pylist(), strict=True))


def ready_blocks(docs: DataFrame, items: DataFrame, similarity: float, radius: int) -> Iterator[tuple[Items, list, bool]]:
    """The benchmark's blocks with the weights of the whole benchmark, their item_ids, and whether
    the block is one of several."""
    spark = docs.sparkSession
    total, counts = items.count(), None
    for rows in blocks(items):
        texts, ids = [r["text"] for r in rows], [r["item_id"] for r in rows]
        if len(rows) == total:
            yield Items(texts, radius), ids, False
            continue
        if counts is None:
            counts = settle(shared_runs(items), "runs")
        block = Items(texts, radius, total)
        own = block.own()
        block.weigh(_had(counts, spark.createDataFrame(pa.Table.from_batches([_run_batch(own)]))))
        sent = spark.sparkContext.broadcast((block, own))

        def go(batches, sent=sent):
            ready, own = sent.value
            for b in batches:
                yield _run_batch(ready.strangers(b["text"], similarity, own))

        block.weigh(_had(counts, docs.select("text").mapInArrow(go, "run long").distinct()))
        sent.unpersist()
        yield block, ids, True


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, start_word, n_words, similarity."""
    spark = docs.sparkSession
    prepare(spark)
    kind, key = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {key}, start_word long, n_words long, similarity double"
    out = spark.createDataFrame([], schema)
    for block, item_ids, several in ready_blocks(docs, items, similarity, radius):
        sent = spark.sparkContext.broadcast((block, item_ids))

        def go(batches, sent=sent):
            ready, ids = sent.value
            for b in batches:
                found = [(d, ids[i], p, n, s) for d, own in zip(b["doc_id"].to_pylist(), ready.leaks(b["text"], similarity), strict=True) for i, p, n, s in own]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                types = [b["doc_id"].type, pa.int64() if key == "bigint" else None, pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if t else pa.array(c) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = docs.select("doc_id", "text").mapInArrow(go, schema)
        if several:
            found = settle(found, "leaks")
            sent.unpersist()
        out = out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    prepare(docs.sparkSession)
    for block, _, several in ready_blocks(docs, items, similarity, radius):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def go(batches, sent=sent):
            for b in batches:
                yield b.filter(pa.array([not own for own in sent.value.leaks(b["text"], similarity)], pa.bool_()))

        docs = docs.mapInArrow(go, docs.schema)
        if several:
            docs = settle(docs, "clean")
            sent.unpersist()
    return docs
