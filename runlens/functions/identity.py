"""Derived identities of experiments and runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MOD32 = 1 << 32
_HALF32 = 1 << 31


def wrap32(value: Column) -> Column:
    """Two's-complement 32-bit wrap of a long."""
    return (F.pmod(value + F.lit(_HALF32), F.lit(_MOD32)) - F.lit(_HALF32)).cast("int")


def java_hash(text: Column) -> Column:
    """``String.hashCode``: base-31 polynomial over UTF-16 units, 32-bit wrap."""

    def step(acc: Column, char: Column) -> Column:
        cp = F.ascii(char).cast("long")
        over = cp - 0x10000
        high, low = F.shiftright(over, 10) + 0xD800, over.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        units = F.when(cp < 0x10000, acc * 31 + cp).otherwise((acc * 31 + high) * 31 + low)
        return units % _MOD32

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return wrap32(F.aggregate(chars, F.lit(0).cast("long"), step))


def experiment_id(name: Column, suite: Column) -> Column:
    return wrap32(java_hash(name).cast("long") * 31 + java_hash(suite))


def run_id(experiment: Column, run: Column) -> Column:
    """Kept for compatibility; (E, run 32) and (E+1, run 1) share a value, so joins use natural keys."""
    return wrap32(experiment.cast("long") * 31 + run)
