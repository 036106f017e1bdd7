"""What is found within one row, in Arrow batches: small helpers in Python over arrays of numbers or the words of a text.

Words are parted in the JVM (``text.tokenize``) and come joined by single spaces, which no word
holds; results go back as flat Arrow arrays, so that no row becomes Python structs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def lists(rows: Iterable, fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """An array of lists of structs: ``rows`` gives a row's values as one list a field, or None."""
    offsets, columns = [0], [[] for _ in fields]
    for row in rows:
        for column, values in zip(columns, row or (), strict=False):
            column.extend(values)
        offsets.append(len(columns[0]))
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def values(items: pa.Array) -> list:
    """``to_pylist`` by whole columns: lists are lists, structs are tuples."""
    kind = items.type
    if pa.types.is_list(kind):
        flat, at, out = values(items.flatten()), 0, []
        for n in items.value_lengths().to_pylist():  # None: a list that is null
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(kind):
        return list(zip(*(values(items.field(i)) for i in range(kind.num_fields)), strict=True))
    return items.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(kind) and not items.null_count else items.to_pylist()


def rows(made: Callable[..., dict | list], kind: str, *columns: str | Column) -> Column:
    """``made`` of each row's values of ``columns`` as a column of ``kind``. A batch is passed over in parts, so that
    few rows at a time are Python values."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(*items: pa.Array) -> pa.Array:
        done = [pa.array([made(*row) for row in zip(*(values(x.slice(at, 128)) for x in items), strict=True)], arrow) for at in range(0, len(items[0]), 128)]
        return pa.concat_arrays(done) if done else pa.array([], arrow)

    return run.asNondeterministic()(*columns)  # so that no optimisation moves it into a lambda, where Python can't run


def spans_of(step: Callable[[list[int]], list[tuple[int, ...]]], names: tuple[str, ...]):
    """A column function: ``step`` of each array of numbers, as an array of structs of whole numbers."""

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:int' for n in names)}>>")
    def run(items: pa.Array) -> pa.Array:
        return lists((list(zip(*step(x), strict=True)) if x else None for x in items.to_pylist()), [(n, pa.int32()) for n in names])

    return run


def _joined(terms: Column) -> Column:
    return F.array_join(terms, " ")


def _words(items: pa.Array) -> Iterable[list[str]]:
    return (x.split(" ") if x else [] for x in items.to_pylist())


def found_phrases(words: list[str]) -> dict[str, tuple[float, int]]:
    """``weight, first_pos`` of each candidate for a key term: words of three letters and more count 1, two in a row 1.5.
    Stop words are in none, and a number alone is none."""
    stop, found, before = _STOP, {}, None
    for i, w in enumerate(words):
        if len(w) < 3 or w in stop:
            before = None
            continue
        if before is not None:
            term = f"{before} {w}"
            weight, at = found.get(term, (0.0, 2 * i - 1))
            found[term] = weight + 1.5, at
        if not (w.isascii() and w.isdigit()):
            weight, at = found.get(w, (0.0, 2 * i))
            found[w] = weight + 1.0, at
        before = w
    return found


_STOP = frozenset(W.STOP_WORDS)


def phrases(terms: Column) -> Column:
    """``term, weight, first_pos`` of ``found_phrases`` in an array of words."""
    return F.arrow_udf(_phrases, "array<struct<term:string,weight:double,first_pos:int>>")(_joined(terms))


def _phrases(items: pa.Array) -> pa.Array:
    def one(words: list[str]):
        found = found_phrases(words)
        return list(found), [w for w, _ in found.values()], [at for _, at in found.values()]

    return lists(map(one, _words(items)), [("term", pa.string()), ("weight", pa.float64()), ("first_pos", pa.int32())])


def counted(terms: Column, wanted: Broadcast[frozenset[str]] | None = None) -> Column:
    """``term, tf, first`` of each distinct term of an array, of ``wanted`` ones if these are given, in the order they are seen in."""

    def one(words: list[str], keep: frozenset[str] | None):
        found: dict[str, int] = {}
        counts, places = [], []
        for i, w in enumerate(words):
            if keep is None or w in keep:
                at = found.setdefault(w, len(places))
                if at == len(places):
                    counts.append(1)
                    places.append(i)
                else:
                    counts[at] += 1
        return list(found), counts, places

    @F.arrow_udf("array<struct<term:string,tf:int,first:int>>")
    def run(items: pa.Array) -> pa.Array:
        keep = wanted and wanted.value
        return lists((one(words, keep) for words in _words(items)), [("term", pa.string()), ("tf", pa.int32()), ("first", pa.int32())])

    return run(_joined(terms))


def strongest(found: dict[str, tuple[float, int]], n: int) -> list[str]:
    """Terms by weight (ties: first seen), none part of another; after three only those of weight 2 and more."""
    kept: list[str] = []
    for term, (weight, _) in sorted(found.items(), key=lambda x: (-x[1][0], x[1][1])):
        if len(kept) >= n or (weight < 2 and len(kept) >= 3):
            break
        if not any(term in y or y in term for y in kept):
            kept.append(term)
    return kept


def leading(words: list[str], n: int) -> list[str]:
    """``strongest`` of ``found_phrases``. Terms of weight 2 and more are those that recur; the others are
    weighed only where these don't make three."""
    good = lambda w: len(w) >= 3 and w not in _STOP
    pairs = list(zip(words, words[1:], strict=False))
    often = {(w,): 1.0 * k for w, k in Counter(words).items() if k > 1 and good(w) and not (w.isascii() and w.isdigit())}
    often |= {p: 1.5 * k for p, k in Counter(pairs).items() if k > 1 and good(p[0]) and good(p[1])}
    at = dict(zip(reversed(words), range(2 * len(words) - 2, -1, -2), strict=True))
    after = dict(zip(reversed(pairs), range(2 * len(words) - 3, 0, -2), strict=True))
    kept = strongest({" ".join(t): (k, at[t[0]] if len(t) == 1 else after[t]) for t, k in often.items()}, n)
    return kept if len(kept) >= min(3, n) else strongest(found_phrases(words), n)


def key_terms(terms: Column, n: int) -> Column:
    """``strongest`` of ``found_phrases`` in an array of words."""

    @F.arrow_udf("array<string>")
    def run(items: pa.Array) -> pa.Array:
        return pa.array([leading(words, n) for words in _words(items)], pa.list_(pa.string()))

    return run(_joined(terms))


def centrality(sentences: list[list[str]]) -> list[float]:
    """The cosine of each sentence's TF-IDF vector to the sum of all of them, where the sentences are given by their words."""
    once = [dict.fromkeys(words, 1) for words in sentences]
    counts = [c if len(c) == len(words) else Counter(words) for c, words in zip(once, sentences, strict=True)]
    df = Counter(chain.from_iterable(counts))
    logs = {n: math.log(1 + len(sentences) / n) for n in set(df.values())}
    idf = {w: logs[n] for w, n in df.items()}
    centre = dict.fromkeys(df, 0.0)
    for c in counts:
        for w, n in c.items():
            centre[w] += n * idf[w]
    cc = sum(x * x for x in centre.values())
    out = []
    for c in counts:
        dot = ww = 0.0
        for w, n in c.items():
            x = n * idf[w]
            dot += x * centre[w]
            ww += x * x
        out.append(dot / (math.sqrt(ww * cc) or 1.0))
    return out


def central(sentences: list[list[str]], places: list[int]) -> list[float]:
    """``centrality`` of each sentence and a little more at the places 0 and 1 of a document, to six digits."""
    prior = {0: 0.08, 1: 0.04}
    return [_six(x + prior.get(at, 0.0)) for x, at in zip(centrality(sentences), places, strict=True)]


def _six(x: float) -> float:
    """Halves go away from zero, by the shortest digits of a number, as Spark's ``round`` has it."""
    near = round(x * 1e6)
    if abs(x * 1e6 - near) < 0.4999:  # far from a half, which is nearly all: the digits aren't needed
        return near / 1e6
    return float(Decimal(repr(x)).quantize(_MILLIONTH, ROUND_HALF_UP))


_MILLIONTH = Decimal("0.000001")
