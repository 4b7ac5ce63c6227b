"""Seeds and integer mixes.

Spark raises where a 64-bit product overflows, so products of 32-bit values are taken in halves of 16 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the mixes.
GOLDEN_32, MIX_1, MIX_2 = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35
GOLDEN_64, STEP_1, STEP_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FINAL_1, FINAL_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
CHAIN = 0x1234ABCD9876EF01
LOW_32, LOW_64 = (1 << 32) - 1, (1 << 64) - 1


def _times_32(x: Column, factor: int) -> Column:
    """x * factor modulo 2 ** 32, for x below 2 ** 33."""
    low = x.bitwiseAND(F.lit(LOW_32))
    high_part = (low * (factor >> 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (high_part + low * (factor & 0xFFFF)).bitwiseAND(F.lit(LOW_32))


def tile_seed(seed: Column, tile_id: Column) -> Column:
    """The 32-bit seed of a tile."""
    x = seed.cast("long").bitwiseAND(F.lit(LOW_32)).bitwiseXOR(tile_id.cast("long") * GOLDEN_32)
    x = _times_32(x.bitwiseXOR(F.shiftright(x, 16)), MIX_1)
    x = _times_32(x.bitwiseXOR(F.shiftright(x, 13)), MIX_2)
    return x.bitwiseXOR(F.shiftright(x, 16)).bitwiseAND(F.lit(LOW_32))


# --- 64 bits and more, as limbs of 16 bits, the lowest first -----------------------------------------------------------

LIMB = 16


def _limbs(x: Column, count: int = 4) -> list[Column]:
    """The bits of a long as limbs; further limbs are 0."""
    own = [F.shiftrightunsigned(x.cast("long"), LIMB * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return own + [F.lit(0).cast("long")] * (count - 4)


def _with(limbs: list[Column], body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of limbs that are computed once for the row."""
    return F.get(F.transform(F.array(F.array(*limbs)), lambda a: body([F.get(a, F.lit(k)) for k in range(len(limbs))])), F.lit(0))


def _carried(sums: list[Column]) -> list[Column]:
    """Limbs of sums per place, the carry of the highest dropped."""
    out, carry = [], F.lit(0).cast("long")
    for value in sums:
        value = value + carry
        out.append(value.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftright(value, LIMB)
    return out


def _plus(limbs: list[Column], number: int) -> list[Column]:
    return _carried([x + (number >> LIMB * k & 0xFFFF) for k, x in enumerate(limbs)])


def _times(limbs: list[Column], factor: int, count: int) -> list[Column]:
    """The ``count`` lowest limbs of the product with a 64-bit factor."""
    part = [factor >> LIMB * k & 0xFFFF for k in range(4)]
    sums = [sum((limbs[i] * part[k - i] for i in range(len(limbs)) if 0 <= k - i < 4), F.lit(0).cast("long")) for k in range(count)]
    return _carried(sums)


def _mixed(limbs: list[Column], shift: int) -> list[Column]:
    """x ^ x >> shift."""
    whole, rest = divmod(shift, LIMB)
    at = lambda k: limbs[k] if k < len(limbs) else F.lit(0).cast("long")
    moved = [F.shiftright(at(k + whole), rest).bitwiseOR(F.shiftleft(at(k + whole + 1), LIMB - rest).bitwiseAND(F.lit(0xFFFF))) for k in range(len(limbs))]
    return [x.bitwiseXOR(y) for x, y in zip(limbs, moved)]


def _long(limbs: list[Column]) -> Column:
    out = limbs[0]
    for k in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[k], LIMB * k))
    return out


def split_mix_column(x: Column) -> Column:
    """``split_mix`` of the 64 bits of a long, as a signed long."""
    held = lambda limbs, body: _with(_carried(limbs), body)
    return held(
        _plus(_limbs(x), GOLDEN_64),
        lambda a: held(_mixed(a, 30), lambda b: held(_times(b, STEP_1, 4), lambda c: held(_mixed(c, 27), lambda d: held(_times(d, STEP_2, 4), lambda e: _long(_mixed(e, 31)))))),
    )


def derived_column(*keys: Column) -> Column:
    """``derived`` of several keys, as a signed long."""
    seed = F.lit(signed(CHAIN))
    for k in keys:
        seed = split_mix_column(seed.bitwiseXOR(k.cast("long")))
    return seed


def wide_tile_seed_column(seed: Column, tile_id: Column) -> Column:
    """``wide_tile_seed``, in limbs enough for the bits that reach the result: 65 of the last product, 98 of the first."""
    start = _with(_limbs(tile_id), lambda t: _long(_times(t, GOLDEN_64, 4)))
    return _with(
        _limbs(seed.cast("long").bitwiseXOR(start)),
        lambda a: _with(
            _mixed(a, 33),
            lambda b: _with(_times(b, FINAL_1, 8), lambda c: _with(_mixed(c, 33), lambda d: _with(_times(d, FINAL_2, 5), lambda e: _mixed(e, 33)[0].bitwiseOR(F.shiftleft(_mixed(e, 33)[1], LIMB))))),
        ),
    )


def seed_array(seed: Column, count: int) -> Column:
    """``count`` seeds, derived from one and their places, as an array of signed longs."""
    return F.array(*[derived_column(seed, F.lit(k)) for k in range(count)])


# --- one at a time ------------------------------------------------------------------------------------------------------


def wide_tile_seed(seed: int, tile_id: int) -> int:
    """The other seed of a tile: its products aren't cut to 64 bits between the steps."""
    x = (seed ^ tile_id * GOLDEN_64) & LOW_64
    for factor in (FINAL_1, FINAL_2):
        x = (x ^ x >> 33) * factor
    return (x ^ x >> 33) & LOW_32


def split_mix(x: int) -> int:
    z = (x + GOLDEN_64) & LOW_64
    z = (z ^ z >> 30) * STEP_1 & LOW_64
    z = (z ^ z >> 27) * STEP_2 & LOW_64
    return z ^ z >> 31


def derived(*keys: int) -> int:
    """A seed from several keys."""
    seed = CHAIN
    for k in keys:
        seed = split_mix(seed ^ (k & LOW_64))
    return seed


def signed(x: int) -> int:
    """The same 64 bits as a signed number."""
    x &= LOW_64
    return x - (1 << 64) if x >> 63 else x
