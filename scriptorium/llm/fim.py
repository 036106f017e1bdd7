"""Fill-in-middle: a document as prefix, suffix and middle, cut between its units.

Units are ``[A-Za-z]+|[^A-Za-z]`` over code points. Every character is first mapped to one
of a few that stand for its class (those of the sentinels stay themselves); one Aho-Corasick
automaton then reports where the class changes and where a sentinel stands. Between two
such events lies one class only: a gap of letters is one unit, a gap of other characters as
many as it is long. So the count of all units and the place of the k-th follow from the
events alone, which long runs of either class don't add to.

Cuts and forms are drawn by the digest of a document's id, so a run repeats itself on any
number of executors. Nothing is shuffled.

Nulls and ties: a null text is an empty one, and an empty one is plain; a null doc_id is
drawn by the digest of the seed alone; repeated rows come out alike, each for itself; both
cuts may fall on one place (an empty middle). Very long texts are cut whole. Further
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20


def _classes() -> bytes:
    """Letters are 'a', all else '.', but what sentinels are made of stays."""
    table = bytearray(b"." * 256)
    for c in range(128):
        if chr(c).isalpha():
            table[c] = ord("a")
    for c in PREFIX + SUFFIX + MIDDLE:
        table[ord(c)] = ord(c)
    return bytes(table)


CLASSES = _classes()


@lru_cache(1)
def automaton():
    """Reports 0 where the class changes, 1 at a sentinel, each by its last character."""
    import ahocorasick

    found = ahocorasick.Automaton()
    kinds = {chr(c) for c in CLASSES}
    for x in kinds:
        for y in kinds:
            if x.isalpha() != y.isalpha():
                found.add_word(x + y, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, 1)
    found.make_automaton()
    return found


class Units:
    """The units of a text: ``n``, whether it holds a sentinel, and where the k-th ends."""

    def __init__(self, text: str):
        said = text.encode("ascii", "replace").translate(CLASSES).decode("ascii")  # a character for a character
        events = np.fromiter(chain.from_iterable(automaton().iter(said)), np.int64).reshape(-1, 2)
        self.marked = bool(events[:, 1].any())
        self.ends = np.concatenate([[0], events[events[:, 1] == 0, 0], [len(said)]] if said else [[0]]).astype(np.int64)
        length = np.diff(self.ends)
        letters = (np.arange(len(length)) + (not said[:1].isalpha())) % 2 == 0  # classes take turns
        self.upto = np.concatenate([[0], np.cumsum(np.where(letters, 1, length))])
        self.n = int(self.upto[-1])

    def place(self, k: int) -> int:
        """The code point at which the first ``k`` units end."""
        j = int(np.searchsorted(self.upto, k))
        return int(self.ends[j] if self.upto[j] == k else self.ends[j - 1] + k - self.upto[j - 1])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers from the digest of the seed and the id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text from its output. It holds no sentinel, so each of the three is found first where it was put."""
    first, second = F.length(F.lit(PREFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    i, j = F.locate(SUFFIX, output, 4), F.locate(MIDDLE, output, 4)
    i = F.when(form == "psm", i).otherwise(F.locate(PREFIX, output, 4))
    one = F.substring(output, first + 1, i - first - 1)
    two = F.substring(output, i + F.length(second), j - i - F.length(second))
    middle = F.substring(output, j + F.length(F.lit(MIDDLE)), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (code points; null if plain), output (text)."""
    prepare(docs.sparkSession)

    def go(batches):
        for b in batches:
            rows = []
            for text, h1, h2, h3, h4 in zip(*(b[k].to_pylist() for k in ("text", "h1", "h2", "h3", "h4")), strict=True):
                u = Units(text)
                if not text or u.marked or h3 % 100 >= plain_from:
                    rows.append((u.n, "plain", None, None, text))
                    continue
                p, q = (u.place(k) for k in sorted((h1 % (u.n + 1), h2 % (u.n + 1))))
                form = "spm" if h4 % 100 < spm_below else "psm"
                rows.append((u.n, form, p, q - p, arranged(form, text[:p], text[p:q], text[q:])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = [h.alias(f"h{k + 1}") for k, h in enumerate(draws(F.col("doc_id"), seed))]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *drawn).mapInArrow(
        go, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def digests(found: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of its outputs and of the texts restored from them, in place of the texts."""
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
