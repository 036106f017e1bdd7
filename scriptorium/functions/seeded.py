"""Random order that repeats for a seed, number for number: 32-bit arithmetic on long columns.

The generator counts: its k-th number follows from the seed and k alone, so a row needs no
state of another row, and a shuffle is a fold over one array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The generator's step and the hash's start and factor.
STEP, HASH_START, HASH_FACTOR = 0x6D2B79F5, 2166136261, 16777619
_MASK = (1 << 32) - 1


def _cut(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def multiplied(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers; no step leaves 64 bits."""
    low, high = a * b.bitwiseAND(F.lit(0xFFFF)), (a * F.shiftrightunsigned(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return _cut(low.bitwiseAND(F.lit(_MASK)) + F.shiftleft(high, 16))


def number(seed: Column, k: Column) -> Column:
    """The ``k``-th number (from 0) of a seed, in [0, 1). A seed of 0 counts as 1."""
    seed = _cut(seed.cast("long"))
    start = F.when(seed == 0, F.lit(1).cast("long")).otherwise(seed)
    state = _cut(start + multiplied(_cut(k.cast("long") + 1), F.lit(STEP).cast("long")))
    mixed = lambda a: multiplied(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    turned = lambda t: t.bitwiseXOR(_cut(t + multiplied(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))))
    last = lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(float(1 << 32))
    return let(let(let(state, mixed), turned), last)


def shuffled(items: Column, seed: Column, skip: Column | int = 0) -> Column:
    """An array in the seed's order (the last place is filled first), from its ``skip``-th number on.
    Arrays are short: each step copies one."""
    skip = F.lit(skip) if isinstance(skip, int) else skip

    def step(done: Column, i: Column) -> Column:
        j = F.floor(number(seed, skip + F.size(done) - 1 - i) * (i + 1)).cast("int")
        return let(j, lambda j: F.transform(done, lambda x, at: F.when(at == i, F.get(done, j)).when(at == j, F.get(done, i)).otherwise(x)))

    places = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, items, step)


def hashed(text: Column) -> Column:
    """A 32-bit hash of a text's UTF-16 units, as a seed."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    places = F.when(F.length(units) > 0, F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(HASH_START).cast("long"), lambda h, i: multiplied(h.bitwiseXOR(unit(i)), F.lit(HASH_FACTOR).cast("long")))
