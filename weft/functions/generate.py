"""Values drawn at random, and the same ones again for the same seed, as Column expressions over whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import text

_MASK = 0xFFFFFFFF
#: The generator's increment, the alphabet of short ids, and the starts of the two hashes of a seeded UUID.
_STEP = 0x6D2B79F5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_STARTS = (5381, 52711)
LONGEST_ID = 256


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without overflow of 64."""
    return _low(a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16))


def _codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _folded(s: Column, start: int, step) -> Column:
    return F.aggregate(_codes(s), F.lit(start).cast("long"), step)


def seed_of(s: Column) -> Column:
    """A text's 31-polynomial hash."""
    return _folded(s, 0, lambda h, c: _low(h * 31 + c))


def draw(seed: Column, turn: Column | int = 1) -> Column:
    """The ``turn``-th number of the generator from the seed on, in [0, 1)."""
    t = _low(seed + (F.lit(turn) if isinstance(turn, int) else turn).cast("long") * _STEP % (1 << 32))
    let = lambda x, fn: F.get(F.transform(F.array(x), fn), 0)

    def mixed(t):
        return let(_times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1))), lambda u: let(u.bitwiseXOR(_low(u + _times(u.bitwiseXOR(F.shiftright(u, 7)), u.bitwiseOR(F.lit(61))))), lambda v: v.bitwiseXOR(F.shiftright(v, 14))))

    return let(t, mixed).cast("double") / float(1 << 32)


def random(low=None, high=None, seed: Column | None = None) -> Column:
    """A number in [0, 1), or a whole one in [low, high]; null where low is over high."""
    u = draw(seed_of(seed)) if seed is not None else F.rand()
    if high is None:
        return u
    lo, hi = F.floor(low), F.floor(high)
    return F.when(low <= high, (lo + F.floor(u * (hi - lo + 1))).cast("double"))


def uuid(seed: Column | None = None) -> Column:
    """Version 4 at random; with a seed that isn't empty, the same one for the same seed."""
    if seed is None:
        return F.uuid()
    octets = []
    for start in _STARTS:
        h = _folded(seed, start, lambda a, c: _low(a * 33).bitwiseXOR(c))
        signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
        octets += [F.shiftright(signed, 4 * k).bitwiseAND(F.lit(0xFF)) for k in range(8)]
    octets[6] = octets[6].bitwiseAND(F.lit(0x0F)).bitwiseOR(F.lit(0x50))
    octets[8] = octets[8].bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    pairs = [F.lpad(F.lower(F.hex(o)), 2, "0") for o in octets]
    return F.when(seed == "", F.uuid()).otherwise(F.concat_ws("-", *[F.concat(*pairs[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 16))]))


def nanoid(size=21, seed: Column | None = None) -> Column:
    """``size`` characters of the alphabet, 256 at most; null for none."""
    n = F.least(F.floor(F.lit(size) if not isinstance(size, Column) else size).cast("int"), F.lit(LONGEST_ID))
    given = F.uuid() if seed is None else F.when(text(seed) == "", F.uuid()).otherwise(text(seed))
    # the seed's hash is bound once for all letters, and so is a random seed, which is drawn anew wherever it stands
    hashed = F.transform(F.array(given), seed_of)
    letters = F.get(F.transform(hashed, lambda h: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.lit(ALPHABET), (F.floor(draw(h, k) * 64) + 1).cast("int"), F.lit(1))), "")), 0)
    return F.when(n > 0, letters)
