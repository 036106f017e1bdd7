"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is encoded by both tokenizers. The byte offsets at which a token of either ends are
two rising sequences; merged, the offsets in both of them cut the tokens into groups, and
every pair of an A and a B token of one group is a link. Links weigh by how many documents
of the whole corpus hold their pair of ids.

A text is read and encoded once. ``mapInPandas`` takes some documents as a block: each of its
distinct units (``Encoders``) is encoded once and cumulative ends are merged over all of them
(units end where both sides end); per document its distinct pairs are kept as places in the
block's own list of pairs. Spark
then counts pairs by block lists (summed per block before anything moves), takes the largest
count by id of either side, joins both back to the block lists by pair, and brings a block's
counts to its documents. So what is shuffled are distinct pairs a block, never occurrences.
A block holds some MB of text, whatever the corpus; maxima are at most one row for each id of a
vocabulary, so that they may be broadcast.

Nulls and ties: texts that are null or empty, or whose token bytes aren't the text's (one
that holds U+2581, for instance), have no tokens: zeros and an empty ``groups``. A null
doc_id is kept; repeated rows are documents of their own, each counted; ties share the
largest count. Very long texts are encoded whole. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, settle
from .packing import _encoders, token_ids, vocabulary

Files = tuple[tuple[str, str, str], str]
_SHIFT = 31
SLICE = 1 << 20  # links counted at once
BLOCK_ROWS, BLOCK_CHARS = 1000, 3 << 20


def vocabularies() -> Files:
    """Paths of the byte-level vocabulary (tokenizers file, ranks, pattern) and of the pieces."""
    import public_tokenizers as P

    return vocabulary(), P.path("piece_bpe_32k.model")


def piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Side:
    """One vocabulary: the bytes of its ids, their lengths, and ids as decimal text."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)

    def written(self, last: str) -> np.ndarray:
        """Texts of id k within a group (at 2k) and at its end (at 2k + 1)."""
        return np.array([f"{k}{mark}" for k in range(len(self.tokens)) for mark in (",", last)], object)


class Encoders:
    """Both sides of a text, unit by unit. A unit begins at a space after a character that isn't
    white space. Neither tokenizer has a token across such a place: the splitting pattern of A
    ends there, and no piece of B goes on with a space after another character (a vocabulary
    with such a piece is refused). So a unit's ids and groups don't depend on its neighbours,
    and a block encodes and aligns each of its distinct units once."""

    def __init__(self, files: Files):
        import sentencepiece

        with open(files[0][1], "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.files, self.pieces = files, sentencepiece.SentencePieceProcessor(model_file=files[1])
        pieces = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on with a space after another character")
        self.a, self.b = Side([ranks.get(k, b"") for k in range(max(ranks) + 1)]), Side([piece_bytes(p) for p in pieces])
        if len(self.a.tokens) * len(self.b.tokens) >= 1 << _SHIFT:
            raise ValueError("the two vocabularies have too many pairs of ids")
        self.space = self.pieces.piece_to_id("▁")
        self.written = np.concatenate([self.a.written("|"), self.b.written(";")])

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each unit by both sides; B adds the space itself."""
        near = _encoders(self.files[0])[1].encode_ordinary  # what token_ids takes where no character is far
        a = [near(u) if u.isascii() else token_ids(u, self.files[0]) for u in units]
        b = self.pieces.encode([u[1:] for u in units], num_threads=1) if units else []
        return a, [y if len(u) > 1 else [self.space] for u, y in zip(units, b, strict=True)]


_UNITS = re.compile(r"(?<=\S)(?= )")
_ODD_SPACE = re.compile(r"\s ")
encoders = lru_cache(2)(Encoders)


def units_of(text: str | None) -> list[str]:
    """A space and the text, as units."""
    if not isinstance(text, str) or not text:
        return []
    text = " " + text
    if _ODD_SPACE.search(text):
        return _UNITS.split(text)
    return [" " + x for x in text[1:].split(" ")]


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token: two rising sequences are merged (a stable
    sort of two runs is one linear merge), and ends that meet in it close a group."""
    order = np.argsort(np.concatenate([a_ends, b_ends]), kind="stable")
    both = np.concatenate([a_ends, b_ends])[order]
    met = np.flatnonzero(both[1:] == both[:-1])  # an A end comes before its equal
    closes_a, closes_b = np.zeros(len(a_ends), np.int64), np.zeros(len(b_ends), np.int64)
    closes_a[order[met]] = 1
    closes_b[order[met + 1] - len(a_ends)] = 1
    return np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b


class Aligned:
    """Distinct units with their groups and links: ``n_a, n_b, n_groups, said, right`` by unit, and the
    links of unit k as ``code[link[k]:link[k + 1]]``."""

    def __init__(self, units: list[str], enc: Encoders):
        x, y = enc.ids(units)
        spelled = lambda side, ids: b"".join(map(side.tokens.__getitem__, ids))
        data = [u.encode() for u in units]
        self.right = np.array([spelled(enc.a, p) == d == spelled(enc.b, q) for d, p, q in zip(data, x, y, strict=True)], bool)
        for k in np.flatnonzero(~self.right):  # of what isn't spelled right no groups are made
            x[k], y[k] = [], []
        sizes = np.array([[len(p), len(q)] for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
        self.n_a, self.n_b = sizes.T
        a, b = (np.array([k for ids in side for k in ids], np.int64) for side in (x, y))
        ga, gb = shared_ends(np.cumsum(enc.a.lengths[a]), np.cumsum(enc.b.lengths[b]))
        groups = int(ga[-1]) + 1 if len(ga) else 0
        na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        to_a, to_b = np.cumsum(na), np.cumsum(nb)  # where a group's tokens end

        # text of the groups: a token's place in it, and whether it ends its side of a group
        flat = np.zeros(len(a) + len(b), np.int64)
        flat[np.arange(len(a)) + (to_b - nb)[ga]] = 2 * a + (np.arange(len(a)) + 1 == to_a[ga])
        flat[np.arange(len(b)) + to_a[gb]] = 2 * len(enc.a.tokens) + 2 * b + (np.arange(len(b)) + 1 == to_b[gb])
        upto = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
        self.said = np.array(["".join(enc.written[flat[i:j]])[:-1] for i, j in zip(upto[:-1], upto[1:], strict=True)], object)

        # links: each A token with every B token of its group
        each = nb[ga]
        opens = np.repeat((to_b - nb)[ga] - (np.cumsum(each) - each), each)
        self.code = np.repeat(a * len(enc.b.tokens), each) + b[opens + np.arange(len(opens))]
        at = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        self.link = np.concatenate([[0], np.cumsum(each)])[at]
        ends = np.concatenate([[0], np.cumsum(np.append(ga[1:] != ga[:-1], True))]) if len(ga) else np.zeros(1, np.int64)
        self.n_groups = np.diff(ends[at])


def aligned_block(texts: list[str | None], files: Files) -> dict[str, list]:
    """Columns of ``align`` for the documents of one block."""
    number: dict[str, int] = {}
    own = [np.array([number.setdefault(u, len(number)) for u in units_of(t)], np.int64) for t in texts]
    units = Aligned(list(number), encoders(files))
    own = [u if units.right[u].all() else u[:0] for u in own]  # token bytes follow the characters: a text is spelled if its units are
    size = np.array([len(u) for u in own], np.int64)
    every, doc = np.concatenate([np.zeros(0, np.int64), *own]), np.repeat(np.arange(len(texts)), size)
    total = lambda by_unit: np.bincount(doc, weights=by_unit[every], minlength=len(texts)).astype(np.int64)
    n_links = np.diff(units.link)
    held, times, first = [], [], 0
    while first < len(every):  # about a million links at a time
        to = max(first + 1, int(np.searchsorted(np.cumsum(n_links[every[first:]]), SLICE, "right")) + first)
        to = int(np.searchsorted(doc, doc[to - 1], "right"))  # whole documents
        u, d = every[first:to], doc[first:to]
        each = n_links[u]
        place = np.repeat(units.link[u] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        found, often = np.unique((np.repeat(d, each) << _SHIFT) + units.code[place], return_counts=True)
        held.append(found)
        times.append(often.astype(np.int32))
        first = to
    held, times = np.concatenate([np.zeros(0, np.int64), *held]), np.concatenate([np.zeros(0, np.int32), *times])
    pairs, place, docs = np.unique(held & ((1 << _SHIFT) - 1), return_inverse=True, return_counts=True)
    cuts = np.searchsorted(held >> _SHIFT, np.arange(1, len(texts)))
    rest = [None] * (len(texts) - 1)
    return {
        "n_a": total(units.n_a), "n_b": total(units.n_b), "n_groups": total(units.n_groups), "n_links": total(n_links), "groups": [";".join(units.said[u]) for u in own],
        "place": np.split(place.astype(np.int32), cuts), "times": np.split(times, cuts), "pairs": [pairs, *rest], "docs": [docs, *rest],
    }


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of whole documents, of ``BLOCK_ROWS`` and ``BLOCK_CHARS`` at most (or one document)."""
    first = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and (k - first >= BLOCK_ROWS or size + n > BLOCK_CHARS):
            yield first, k
            first, size = k, 0
        size += n
    if texts:
        yield first, len(texts)


def align(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """Per document: doc_id (as text), n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``),
    and for ``weighed``: block, the places of its pairs in the block's list, how often it has
    each, and on a block's first row that list with the number of its documents by pair."""
    files = files or vocabularies()
    prepare(docs.sparkSession)

    def go(frames):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for f in frames:
            ids, texts = f["doc_id"].tolist(), [t if isinstance(t, str) else None for t in f["text"]]
            for a, b in blocks(texts):
                yield pd.DataFrame({"doc_id": ids[a:b], "block": block, **aligned_block(texts[a:b], files)})
                block += 1

    # as text a null id stays null in pandas
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        go,
        "doc_id string, block long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "place array<int>, times array<int>, pairs array<long>, docs array<long>",
    )


def block_pairs(aligned: DataFrame) -> DataFrame:
    """``block, pair, docs``: the distinct pairs of each block."""
    return aligned.where("pairs is not null").select("block", F.inline(F.arrays_zip("pairs", "docs"))).withColumnRenamed("pairs", "pair")


def link_counts(pairs: DataFrame, files: Files | None = None) -> DataFrame:
    """``pair, a, b, count, best_a, best_b``: how many documents hold a pair linked, and the
    largest such count of its A id and of its B id."""
    width = len(encoders(files or vocabularies()).b.tokens)
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = settle(counts.withColumns({"a": F.floor(F.col("pair") / width), "b": F.col("pair") % width}), "pair_counts")
    best = lambda side: F.broadcast(counts.groupBy(side).agg(F.max("count").alias(f"best_{side}")))  # noqa: E731  a row an id
    return counts.join(best("a"), "a").join(best("b"), "b").select("pair", "a", "b", "count", "best_a", "best_b")


def weighed(aligned: DataFrame, files: Files | None = None) -> DataFrame:
    """``aligned``, written once, with the sums over links of its documents: n_best (links
    whose count is the largest of their A id), n_best_b (of their B id), count_sum."""
    aligned = settle(aligned, "aligned")
    pairs = block_pairs(aligned)
    found = pairs.join(link_counts(pairs, files), "pair").select(F.col("block").alias("of_block"), "pair", "count", "best_a", "best_b")
    rest = [c for c in aligned.columns if c not in ("place", "times", "pairs", "docs")]

    def sums(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("pair")  # a pair's place in the block's list is its rank
        count = counts["count"].to_numpy(np.int64)
        out, size = docs[rest].copy(), docs["place"].str.len().to_numpy(np.int64)
        doc = np.repeat(np.arange(len(docs)), size)
        place, times = (np.concatenate([np.zeros(0, np.int64), *docs[c]]).astype(np.int64) for c in ("place", "times"))
        for name, value in (("n_best", count == counts["best_a"].to_numpy()), ("n_best_b", count == counts["best_b"].to_numpy()), ("count_sum", count)):
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, doc, times * value[place])
            out[name] = total
        return out

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"{c} long" for c in ("n_best", "n_best_b", "count_sum")])
    return aligned.drop("pairs", "docs").groupBy("block").cogroup(found.groupBy("of_block")).applyInPandas(sums, schema).drop("block")


def cross_tokenizer_alignment(docs: DataFrame, files: Files | None = None, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups, n_best, n_best_b,
    count_sum. With ``digest``, groups_sha256 in place of groups (empty where there are none),
    made before anything is written."""
    found = align(docs, files)
    if digest:
        found = found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    kind = docs.schema["doc_id"].dataType
    return weighed(found, files).withColumn("doc_id", F.col("doc_id").cast(kind))
