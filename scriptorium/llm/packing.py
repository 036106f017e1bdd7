"""Best-fit packing: the sum-of-squares rule over the residual gaps of open sequences.

A document is its token ids and a closing id. One longer than ``capacity`` is cut into
pieces of ``capacity`` ids, of which the first may be shorter; pieces are then dealt
evenly to groups of bounded size, and within a group each goes to the open sequence that
makes the sum over gaps of the squared number of open sequences with that gap smallest.
Pieces are placed longest first and a new sequence opens only where no open one has room
(on the test tables this comes within 0.03 % of the least number; opening one whenever
that lowers the sum costs 0.75 % more). Full pieces need no search.

Ids come from the byte-level vocabulary through its rank file where every character is
below U+0250, and from the ``tokenizers`` file elsewhere (the two programs read the
splitting pattern by different versions of Unicode); tests hold the two equal. The string
of a special token in a text is ordinary text, or with ``special_ids`` that token's id, as
an untouched tokenizer has it.

Nulls and ties: a null or empty text is the closing id alone; a null doc_id is kept;
repeated rows are packed each on its own; equal choices go to the smaller gap, and there
to the sequence opened last. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, settle

CAPACITY = 1024
CLOSING_ID = 2
GROUP = 60_000
_FAR = re.compile("[^\x00-ɏ]")


def vocabulary() -> tuple[str, str, str]:
    """Paths of the tokenizers file and of the same vocabulary's ranks, and the pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@lru_cache(2)
def _encoders(files: tuple[str, str, str]):
    import tiktoken
    import tokenizers

    whole, slow = (tokenizers.Tokenizer.from_file(files[0]) for _ in range(2))
    slow.encode_special_tokens = True  # such strings in a text are ordinary text
    special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or "(?!)")
    with open(files[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=files[2], mergeable_ranks=ranks, special_tokens={})
    return slow, fast, whole, special


def token_ids(text: str | None, files: tuple[str, str, str], special_ids: bool = False) -> list[int]:
    slow, fast, whole, special = _encoders(files)
    text = text or ""
    if special_ids and special.search(text):
        return whole.encode(text, add_special_tokens=False).ids
    return slow.encode(text, add_special_tokens=False).ids if _FAR.search(text) else fast.encode_ordinary(text)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``length`` ids."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, closing: int = CLOSING_ID, files: tuple[str, str, str] | None = None, special_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, without the ids themselves."""
    files = files or vocabulary()
    prepare(docs.sparkSession)

    def go(batches):
        for b in batches:
            ids, rows = b["doc_id"].to_pylist(), []
            for doc, text in zip(ids, b["text"], strict=True):
                data = np.array([*token_ids(text.as_py(), files, special_ids), closing], "<u4")
                rows += [(doc, k, s, n, zlib.crc32(data[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(data), capacity))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [b["doc_id"].type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(go, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and the offset of each piece, placed longest first."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one isn't open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for k in order:
        s = int(lengths[k])
        if s == capacity:
            where[k] = opened
            opened += 1
            continue
        held, after = count[s:capacity], count[: capacity - s]
        change = np.where(held > 0, 2 * (after - held + 1), np.iinfo(np.int64).max)
        if held[0]:
            change[0] = 1 - 2 * held[0]  # it fills the sequence, which is no longer open
        best = int(change.argmin())
        if held.any():  # a new sequence opens only where no open one has room
            gap = s + best
            seq = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, seq = capacity, opened
            opened += 1
        where[k], offset[k] = seq, capacity - gap
        if gap > s:
            stacks[gap - s].append(seq)
            count[gap - s] += 1
    return where, offset


def pack(cut_up: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut_up`` with ``sequence_id`` and ``offset``. Pieces are dealt evenly, whatever
    their document, to tasks that pack at most about ``group`` of them together."""
    tasks = max(1, -(-cut_up.count() // group))
    cols, out = cut_up.columns, cut_up.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def go(batches):
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        where, offset = sum_of_squares(t["length"].to_numpy(), capacity)
        where += TaskContext.get().partitionId() << 32
        t = t.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=10_000)

    return cut_up.repartition(tasks).select(*cols).mapInArrow(go, out)


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, closing: int = CLOSING_ID, files: tuple[str, str, str] | None = None, special_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(settle(pieces(docs, capacity, closing, files, special_ids), "pieces"), capacity)
