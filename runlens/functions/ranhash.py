"""Seekable pseudo-random numbers as plain columns.

The generator is the 64-bit hash of Numerical Recipes (3rd ed., p. 352) on ``seed + position``: any
row computes its own draw, so generated data does not depend on partitioning. Longs raise on
overflow under ANSI, so the two wrapping products are put together from 22-bit limbs, which stay
below 2**47. Every step is its own projection: the optimizer leaves them apart, as each value is
used more than once, and code generation turns them into local variables. The draw itself is
``evaluated``: a predicate on it would otherwise be rewritten into an expression of thousands of
terms on its way down the projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runlens.functions.once import evaluated

# Generator constants.
FIRST_FACTOR = 3935559000370003845
INCREMENT = 2691343689449507681
SECOND_FACTOR = 4768777513237032717
TWO_POW_NEG_64 = 5.4210108624275221700e-20
DEFAULT_SEED = 0xC00FFEE

_BITS = 22
_M22 = (1 << 22) - 1
_M20 = (1 << 20) - 1
_M44 = (1 << 44) - 1

_X, _X0, _X1, _X2, _LO, _HI, _MID = (f"__rh_{n}" for n in ("x", "0", "1", "2", "lo", "hi", "mid"))


def _multiply_add(df: DataFrame, factor: int, increment: int) -> DataFrame:
    """x := factor * x + increment, modulo 2**64."""
    c0, c1, c2 = factor & _M22, (factor >> 22) & _M22, (factor >> 44) & _M20
    x = F.col(_X)
    df = df.withColumns({
        _X0: x.bitwiseAND(F.lit(_M22)),
        _X1: F.shiftrightunsigned(x, _BITS).bitwiseAND(F.lit(_M22)),
        _X2: F.shiftrightunsigned(x, 2 * _BITS),
    })
    x0, x1, x2 = F.col(_X0), F.col(_X1), F.col(_X2)
    df = df.withColumn(_MID, x0 * F.lit(c1) + x1 * F.lit(c0))
    mid = F.col(_MID)
    df = df.withColumns({
        _LO: x0 * F.lit(c0) + F.lit(increment & _M44) + F.shiftleft(mid.bitwiseAND(F.lit(_M22)), _BITS),
        _HI: F.shiftright(mid, _BITS) + x0 * F.lit(c2) + x1 * F.lit(c1) + x2 * F.lit(c0)
        + F.lit(increment >> 44),
    })
    lo = F.col(_LO)
    high = (F.col(_HI) + F.shiftright(lo, 44)).bitwiseAND(F.lit(_M20))
    return df.withColumn(_X, F.shiftleft(high, 44).bitwiseOR(lo.bitwiseAND(F.lit(_M44))))


def _xor_shift(df: DataFrame, shift, bits: int) -> DataFrame:
    x = F.col(_X)
    return df.withColumn(_X, x.bitwiseXOR(shift(x, bits)))


def with_uniform(df: DataFrame, position: Column, out: str = "u", seed: int = DEFAULT_SEED) -> DataFrame:
    """Add the draw in (0, 1) at ``position`` of the sequence that starts at ``seed``."""
    keep = df.columns
    df = df.withColumn(_X, position.cast("long") + F.lit(seed))
    df = _multiply_add(df, FIRST_FACTOR, INCREMENT)
    df = _xor_shift(_xor_shift(_xor_shift(df, F.shiftright, 21), F.shiftleft, 37), F.shiftright, 4)
    df = _multiply_add(df, SECOND_FACTOR, 0)
    df = _xor_shift(_xor_shift(_xor_shift(df, F.shiftleft, 20), F.shiftright, 41), F.shiftleft, 5)
    draw = F.col(_X).cast("double") * F.lit(TWO_POW_NEG_64) + F.lit(0.5)
    return evaluated(df, **{out: draw}).select(*[F.col(f"`{c}`") for c in keep], out)


def with_bounded_int(df: DataFrame, position: Column, bound: int, out: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add a draw from 0 .. bound-1."""
    df = with_uniform(df, position, "__rh_u", seed)
    return df.withColumn(out, F.floor(F.col("__rh_u") * bound).cast("int")).drop("__rh_u")
