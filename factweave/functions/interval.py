"""Intervals as pairs of long columns.

The lowest and highest long stand for minus and plus infinity; a null bound, lo > hi, +oo below or -oo above is bottom, the empty
interval. All of it is built from column expressions, so it stays in generated code.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG, POS = -9223372036854775808, 9223372036854775807


class Interval(NamedTuple):
    lo: Column
    hi: Column

    def alias(self, lo: str = "lo", hi: str = "hi") -> list[Column]:
        return [self.lo.alias(lo), self.hi.alias(hi)]


def interval(lo: str | Column, hi: str | Column) -> Interval:
    """Bottom is made null on both sides: crossed bounds, and plus (minus) infinity as the lower (upper) one."""
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (lo, hi))
    there = (lo <= hi) & (lo != POS) & (hi != NEG)
    return Interval(F.when(there, lo), F.when(there, hi))


def text(x: Interval) -> Column:
    """As a report shows it: [0, +oo], or bot."""
    bound = lambda v: F.when(v == NEG, "-oo").when(v == POS, "+oo").otherwise(v.cast("string"))
    return F.when(x.lo.isNull(), "bot").otherwise(F.concat(F.lit("["), bound(x.lo), F.lit(", "), bound(x.hi), F.lit("]")))


def constant(value: int) -> Interval:
    return Interval(F.lit(value).cast("long"), F.lit(value).cast("long"))


TOP = (NEG, POS)


def is_bottom(x: Interval) -> Column:
    return x.lo.isNull()


def _strict(cond: Column, lo: Column, hi: Column) -> Interval:
    return Interval(F.when(cond, lo), F.when(cond, hi))


def join(x: Interval, y: Interval) -> Interval:
    return Interval(F.least(x.lo, y.lo), F.greatest(x.hi, y.hi))  # both skip nulls


def meet(x: Interval, y: Interval) -> Interval:
    both = x.lo.isNotNull() & y.lo.isNotNull()
    lo, hi = F.greatest(x.lo, y.lo), F.least(x.hi, y.hi)
    return _strict(both & (lo <= hi), lo, hi)


def le(x: Interval, y: Interval) -> Column:
    """Whether x lies in y; bottom lies in all."""
    return F.when(is_bottom(x), True).when(is_bottom(y), False).otherwise((y.lo <= x.lo) & (x.hi <= y.hi))


def widen(old: Interval, new: Interval, thresholds: list[int]) -> Interval:
    """A bound that moved goes to the next threshold, or to infinity."""
    steps = F.array(*[F.lit(int(t)).cast("long") for t in sorted(thresholds)]) if thresholds else F.array().cast("array<long>")
    down = F.coalesce(F.array_max(F.filter(steps, lambda t: t <= new.lo)), F.lit(NEG))
    up = F.coalesce(F.array_min(F.filter(steps, lambda t: t >= new.hi)), F.lit(POS))
    lo = F.when(new.lo < old.lo, down).otherwise(old.lo)
    hi = F.when(new.hi > old.hi, up).otherwise(old.hi)
    return Interval(
        F.when(is_bottom(old), new.lo).when(is_bottom(new), old.lo).otherwise(lo),
        F.when(is_bottom(old), new.hi).when(is_bottom(new), old.hi).otherwise(hi),
    )


def narrow(old: Interval, new: Interval, thresholds: list[int] = ()) -> Interval:
    """Bounds that widening may have set, infinite or at a threshold, are taken from `new`, which must lie in `old` (an error else). Bottom if either is."""
    wide = lambda bound, end: bound.isin(end, *[int(t) for t in thresholds])
    checked = F.when(is_bottom(old) | le(new, old), F.lit(True)).otherwise(F.raise_error(F.lit("narrow: the new interval isn't in the old one")).cast("boolean"))
    lo, hi = F.when(wide(old.lo, NEG), new.lo).otherwise(old.lo), F.when(wide(old.hi, POS), new.hi).otherwise(old.hi)
    return _strict(checked & old.lo.isNotNull() & new.lo.isNotNull(), lo, hi)


def _clamp(value: Column) -> Column:
    """A decimal or null (no value) back to a long, infinite beyond its range."""
    return F.when(value <= NEG, F.lit(NEG)).when(value >= POS, F.lit(POS)).otherwise(value.cast("long"))


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def plus(x: Interval, y: Interval) -> Interval:
    """Sums beyond a long are infinite, and an infinite lower (upper) bound of either makes the sum's infinite, so adding opposite infinities is no error."""
    lo = F.when((x.lo == NEG) | (y.lo == NEG), F.lit(NEG)).otherwise(_clamp(_wide(x.lo) + _wide(y.lo)))
    hi = F.when((x.hi == POS) | (y.hi == POS), F.lit(POS)).otherwise(_clamp(_wide(x.hi) + _wide(y.hi)))
    return _strict(x.lo.isNotNull() & y.lo.isNotNull(), lo, hi)


def _quotient(a: Column, b: Column) -> Column:
    """a / b towards zero; an infinite dividend gives infinity by the signs, whatever the divisor, and an infinite divisor of a finite one 0. `b` isn't 0."""
    sign = F.signum(a) * F.signum(b)
    far = F.when(sign > 0, F.lit(POS)).otherwise(F.lit(NEG))
    whole = F.try_divide(_wide(a), F.when(b != 0, _wide(b)))
    return F.when(a.isin(NEG, POS), far).when(b.isin(NEG, POS), F.lit(0).cast("long")).otherwise(F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("long"))


def divide(x: Interval, y: Interval) -> Interval:
    """Quotients towards zero; anything where the divisor may be zero, bottom where either is."""
    four = [_quotient(a, b) for a in x for b in y]
    zero = (y.lo <= 0) & (y.hi >= 0)
    both = x.lo.isNotNull() & y.lo.isNotNull()
    return _strict(both, F.when(zero, F.lit(NEG)).otherwise(F.least(*four)), F.when(zero, F.lit(POS)).otherwise(F.greatest(*four)))


def negate(x: Interval) -> Interval:
    lo = F.when(x.hi == POS, F.lit(NEG)).when(x.hi == NEG, F.lit(POS)).otherwise(F.try_subtract(F.lit(0).cast("long"), x.hi))
    hi = F.when(x.lo == NEG, F.lit(POS)).when(x.lo == POS, F.lit(NEG)).otherwise(F.try_subtract(F.lit(0).cast("long"), x.lo))
    return Interval(lo, hi)


def minus(x: Interval, y: Interval) -> Interval:
    return plus(x, negate(y))


def _product(a: Column, b: Column) -> Column:
    endless = a.isin(NEG, POS) | b.isin(NEG, POS)
    sign = F.signum(a) * F.signum(b)
    far = F.when(sign > 0, F.lit(POS)).when(sign < 0, F.lit(NEG)).otherwise(F.lit(0))
    return F.when(endless, far).otherwise(_clamp(_wide(a) * _wide(b)))


def times(x: Interval, y: Interval) -> Interval:
    four = [_product(a, b) for a in x for b in y]
    return _strict(x.lo.isNotNull() & y.lo.isNotNull(), F.least(*four), F.greatest(*four))


def compare(op: str, x: Interval, y: Interval) -> Interval:
    """[1, 1], [0, 0] or [0, 1]: whether x op y holds for all, none or some values."""
    sure, never = {
        "lt": (x.hi < y.lo, x.lo >= y.hi), "le": (x.hi <= y.lo, x.lo > y.hi), "gt": (x.lo > y.hi, x.hi <= y.lo), "ge": (x.lo >= y.hi, x.hi < y.lo),
        "eq": ((x.lo == x.hi) & (y.lo == y.hi) & (x.lo == y.lo), (x.hi < y.lo) | (y.hi < x.lo)),
        "ne": ((x.hi < y.lo) | (y.hi < x.lo), (x.lo == x.hi) & (y.lo == y.hi) & (x.lo == y.lo)),
    }[op]
    both = x.lo.isNotNull() & y.lo.isNotNull()
    return _strict(both, F.when(sure, 1).otherwise(0).cast("long"), F.when(never, 0).otherwise(1).cast("long"))


def prune(op: str, x: Interval, y: Interval) -> Interval:
    """The part of x for which x op y can hold."""
    below = lambda v, k: F.when(v.isin(NEG, POS), v).otherwise(v + k)
    top = constant(NEG).lo, constant(POS).hi
    if op == "eq":
        return meet(x, y)
    if op == "ne":
        single = y.lo == y.hi
        lo = F.when(single & (x.lo == y.lo), below(x.lo, 1)).otherwise(x.lo)
        hi = F.when(single & (x.hi == y.hi), below(x.hi, -1)).otherwise(x.hi)
        return _strict(x.lo.isNotNull() & y.lo.isNotNull() & (lo <= hi), lo, hi)
    limit = {"lt": (top[0], below(y.hi, -1)), "le": (top[0], y.hi), "gt": (below(y.lo, 1), top[1]), "ge": (y.lo, top[1])}[op]
    return meet(x, _strict(y.lo.isNotNull(), *limit))


def eq(x: Interval, y: Interval) -> Column:
    """Whether x and y hold the same values; two bottoms do."""
    return x.lo.eqNullSafe(y.lo) & x.hi.eqNullSafe(y.hi)


def _truth(x: Interval) -> tuple[Column, Column]:
    """Whether x is surely true (without zero) and surely false (only zero)."""
    return (x.lo > 0) | (x.hi < 0), (x.lo == 0) & (x.hi == 0)


def logical_not(x: Interval) -> Interval:
    true, false = _truth(x)
    return _strict(x.lo.isNotNull(), F.when(false, 1).otherwise(0).cast("long"), F.when(true, 0).otherwise(1).cast("long"))


def logical_and(x: Interval, y: Interval) -> Interval:
    """[1, 1] if both are surely true, [0, 0] if one is surely false, else [0, 1]; bottom if either is."""
    (x_true, x_false), (y_true, y_false) = _truth(x), _truth(y)
    return _strict(x.lo.isNotNull() & y.lo.isNotNull(), F.when(x_true & y_true, 1).otherwise(0).cast("long"), F.when(x_false | y_false, 0).otherwise(1).cast("long"))


def logical_or(x: Interval, y: Interval) -> Interval:
    """[1, 1] if one is surely true, [0, 0] if both are surely false, else [0, 1]; bottom if either is."""
    (x_true, x_false), (y_true, y_false) = _truth(x), _truth(y)
    return _strict(x.lo.isNotNull() & y.lo.isNotNull(), F.when(x_true | y_true, 1).otherwise(0).cast("long"), F.when(x_false & y_false, 0).otherwise(1).cast("long"))


def shift_left(x: Interval, y: Interval) -> Interval:
    """Single values shifted (by less than 64 bits, as longs), anything else any value; bottom if either is."""
    both = x.lo.isNotNull() & y.lo.isNotNull()
    finite = (x.lo == x.hi) & (y.lo == y.hi) & ~x.lo.isin(NEG, POS) & y.lo.between(0, 63)
    moved = F.call_function("shiftleft", x.lo, y.lo.cast("int"))
    return _strict(both, F.when(finite, moved).otherwise(F.lit(NEG)), F.when(finite, moved).otherwise(F.lit(POS)))


def absolute(x: Interval) -> Interval:
    """Absolute values; beyond a long infinite."""
    y = negate(x)
    crosses = (x.lo < 0) & (x.hi > 0)
    lo, hi = F.least(F.abs(F.greatest(x.lo, F.lit(-POS))), F.abs(F.greatest(x.hi, F.lit(-POS)))), F.greatest(x.hi, y.hi)
    return _strict(x.lo.isNotNull(), F.when(crosses, F.lit(0).cast("long")).otherwise(lo), hi)


def height(x: Interval, most: int = 1000) -> Column:
    """How many values x has, `most` at most."""
    n = _wide(x.hi) - _wide(x.lo) + 1
    return F.when(is_bottom(x), 0).when(x.lo.isin(NEG, POS) | x.hi.isin(NEG, POS) | (n > most), most).otherwise(n).cast("long")


def spread_of(x: Interval) -> Column:
    """hi - lo, 0 where a bound is infinite or x is bottom."""
    endless = x.lo.isin(NEG, POS) | x.hi.isin(NEG, POS)
    return F.when(is_bottom(x) | endless, 0).otherwise(_clamp(_wide(x.hi) - _wide(x.lo))).cast("long")


#: Bytes, whether unsigned, and the lowest and highest value of an integer type, as the analysis takes them to be.
INTEGERS = {
    "unsigned char": (1, True, 0, 255), "unsigned short": (2, True, 0, 65535), "unsigned int": (4, True, 0, 4294967295),
    "unsigned long": (8, True, -2147483648, 2147483648), "unsigned long long": (8, True, 0, 4294967295),
    "char": (1, False, -128, 255), "short": (2, False, -32768, 32767), "int": (4, False, -2147483648, 2147483648),
    "long": (8, False, 0, 4294967295), "long long": (8, False, -2147483648, 2147483648),
}


def of_type(name: str) -> Interval:
    """All values of an integer type; any value for a type that isn't one."""
    _, _, lo, hi = INTEGERS.get(name, (0, False, NEG, POS))
    return Interval(F.lit(lo).cast("long"), F.lit(hi).cast("long"))


def cast(source: str, target: str, x: Interval, *, overflow: bool = True) -> Interval:
    """x as `target`, with overflow: any value where the upper bound doesn't fit a narrower type (or a signed one of equal
    size, from unsigned); absolute values from signed to an unsigned type at least as wide. Without: absolute values as unsigned, else x."""
    (size, unsigned, _, _), (to_size, to_unsigned, _, most) = INTEGERS[source], INTEGERS[target]
    if not overflow:
        return absolute(x) if to_unsigned else x
    if size < to_size or (size == to_size and not (unsigned and not to_unsigned)):
        return absolute(x) if to_unsigned and not unsigned else x
    fits = x.hi <= most
    return _strict(x.lo.isNotNull(), F.when(fits, x.lo).otherwise(F.lit(NEG)), F.when(fits, x.hi).otherwise(F.lit(POS)))
