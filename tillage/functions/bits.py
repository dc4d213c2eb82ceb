"""Expressions on 64-bit picture hashes held as longs, and the blocking keys of the look-alike search."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pictures whose hashes differ in at most this many of 64 bits look the same.
NEAR_BITS = 5

# Blocking keys. The 64 bits are cut into 8 chunks of 8 bits. At most 5 differing bits leave at least 3 chunks equal, so two
# equal chunks lie in the same half: these 12 chunk pairs meet for every such pair of hashes. A chunk takes one bit of
# every row and column of the hash, so a flat border, common to many pictures, does not make whole chunks equal.
CHUNK_PAIRS = [(i, j) for half in (range(0, 4), range(4, 8)) for i in half for j in half if i < j]
# An over-full key is split by one of six parts of its remaining bits: 5 differing bits leave at least one part equal.
PARTS = NEAR_BITS + 1
LEVELS = 4


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def _signed(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


@cache
def _masks(level: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Per key path of a level: the mask of the bits that must be equal, the mask added last, and the free bits."""
    if level == 1:
        chunk = lambda c: [8 * row + col for row in range(8) for col in range(8) if (row + col) % 8 == c]
        fixed = [sorted(chunk(i) + chunk(j)) for i, j in CHUNK_PAIRS]
        own = [_signed(f) for f in fixed]
        return tuple(own), tuple(own), tuple(tuple(b for b in range(64) if b not in f) for f in fixed)
    before, _, free = _masks(level - 1)
    fixed_, own_, free_ = [], [], []
    for mask, bits in zip(before, free):
        for part in range(PARTS):
            added = bits[part::PARTS]
            own_.append(_signed(list(added)))
            fixed_.append(mask | own_[-1])
            free_.append(tuple(b for b in bits if b not in added))
    return tuple(fixed_), tuple(own_), tuple(free_)


def _longs(values: tuple[int, ...]) -> Column:
    return F.lit(list(values)).cast("array<bigint>")


def first_keys(h: Column) -> Column:
    """The level-1 keys of a hash: an array of (path, v)."""
    return F.array(*[F.struct(F.lit(p).alias("path"), h.bitwiseAND(F.lit(m)).alias("v")) for p, m in enumerate(_masks(1)[0])])


def deeper_keys(h: Column, path: Column, level: int) -> Column:
    """The six keys below ``path`` of the level above: an array of (path, v)."""
    masks = _longs(_masks(level)[0])
    return F.transform(
        F.sequence(path * PARTS, path * PARTS + PARTS - 1),
        lambda p: F.struct(p.alias("path"), h.bitwiseAND(F.element_at(masks, p + 1)).alias("v")),
    )


def is_first_key(x: Column, path: Column, level: int) -> Column:
    """Is ``path`` the first key, on every level, on which two hashes agree? ``x`` is their exclusive-or."""
    own = _longs(_masks(level)[1])
    if level == 1:
        free = F.transform(own, lambda m: x.bitwiseAND(m) == 0)
        return F.array_position(free, True) - 1 == path
    above = F.floor(path / PARTS).cast("int")
    siblings = F.slice(own, above * PARTS + 1, F.lit(PARTS))
    free = F.transform(siblings, lambda m: x.bitwiseAND(m) == 0)
    return (F.array_position(free, True) - 1 == path - above * PARTS) & is_first_key(x, above, level - 1)
