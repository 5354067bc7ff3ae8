"""A counter-based random generator as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: Fixed value: the increment of Mulberry32.
INCREMENT = 0x6D2B79F5


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _multiply(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of 32-bit numbers, in halves so that nothing overflows."""
    high = F.shiftrightunsigned(a, 16) * b.bitwiseAND(F.lit(0xFFFF)) + a.bitwiseAND(F.lit(0xFFFF)) * F.shiftrightunsigned(b, 16)
    return _mask(F.shiftleft(_mask(high).bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b.bitwiseAND(F.lit(0xFFFF)))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, so that nesting does not multiply the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mulberry32(seed: int, draw: Column) -> Column:
    """Draw number ``draw`` (from 0) of Mulberry32: its state is a counter, so draws need no order."""
    if not 0 <= seed < 2**32:
        raise ValueError("the seed must be an unsigned 32-bit integer")
    one, more = F.lit(1).cast("long"), F.lit(61).cast("long")
    step = _mask(F.lit(seed).cast("long") + _multiply(_mask(draw.cast("long") + 1), F.lit(INCREMENT).cast("long")))
    first = _bind(step, lambda a: _multiply(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(one)))
    second = _bind(first, lambda t: t.bitwiseXOR(_mask(t + _multiply(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(more)))))
    return _bind(second, lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14))) / F.lit(4294967296.0)
