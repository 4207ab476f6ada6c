"""Numbers as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Significant digits, and the exponents from and below which they are written without one.
DIGITS, LEAST, MOST = 6, -4, 6
#: Exponents between which the power of ten that brings the digits before the point is a double itself. Beyond, Spark's own
#: formatting takes over: no number there is half-way between two texts.
FROM, TO = -17, 27
#: Splits a double into two halves whose products are exact.
HALVES = 2.0**27 + 1


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)``, with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _strip(s: Column) -> Column:
    return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def general(x: Column) -> Column:
    """A number with six significant digits as C's %g writes it: ties to even, no trailing zeros, exponents where short.

    The digits are the size times a power of ten, rounded. Where that product seems to be half-way between two numbers, the
    part of it that a double does not hold decides, and only a true half goes to even. Numbers whose shortest text has
    six digits at most are common, and need none of that: that text is what %g writes.
    """
    short = x.cast("string")
    plain = F.when(short.endswith(".0"), F.substring(short, F.lit(1), F.length(short) - 2)).otherwise(short)
    few = (F.length(short) <= DIGITS + 1) & short.rlike(r"^[0-9]++\.[0-9]++\z")
    return F.when(few, plain).otherwise(F.coalesce(_common(x.cast("double")), _let(x.cast("double"), _general)))


def _common(x: Column) -> Column:
    """The text of a number from 1 to below 999999 that is not nearly half-way between two texts, null for any other.

    A number of six digits has one nearest double, whose own text is those digits (or more, in JVMs whose texts are not the
    shortest: those give null)."""
    power = F.lit(10.0 ** (DIGITS - 1))
    for e in range(1, DIGITS):
        power = F.when(x >= 10.0**e, F.lit(10.0 ** (DIGITS - 1 - e))).otherwise(power)
    big = x * power
    text = lambda s: F.when(s.endswith(".0"), F.substring(s, F.lit(1), F.length(s) - 2)).when(F.length(s) <= DIGITS + 1, s)
    clear = F.abs(big - F.floor(big) - 0.5) > 1e-4
    return F.when((x >= 1) & (x < 10**DIGITS - 1) & clear, _let((F.rint(big) / power).cast("string"), text))


def _general(x: Column) -> Column:
    size = F.abs(x)
    usual = _let(F.floor(F.log10(size)).cast("int"), lambda e: F.when(e.between(FROM, TO), _digits(size, e)).otherwise(_science(size)))
    sign = F.when(F.signum(x) < 0, "-").when(x.cast("string") == "-0.0", "-").otherwise("")
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size == 0, F.concat(sign, F.lit("0"))).otherwise(F.concat(sign, usual))


def _lost(a: Column, b: Column, product: Column) -> Column:
    """What the product of two doubles lacks of the exact one."""
    halves = lambda x: _let(x * HALVES, lambda big: big - (big - x))
    return _let(F.struct(halves(a).alias("a"), halves(b).alias("b")), lambda h: ((h["a"] * h["b"] - product) + h["a"] * (b - h["b"]) + (a - h["a"]) * h["b"]) + (a - h["a"]) * (b - h["b"]))


def _nearest(x: Column, beyond: Callable[[], Column]) -> Column:
    """The nearest integer to x and a little more, whose sign ``beyond`` gives."""
    low = F.floor(x)
    return F.when(x - low != 0.5, F.rint(x).cast("long")).otherwise(_let(beyond(), lambda r: F.when(r > 0, low + 1).when(r < 0, low).otherwise(F.rint(x).cast("long"))))


def _digits(size: Column, e: Column) -> Column:
    places = F.lit(DIGITS - 1) - e
    power = F.pow(F.lit(10.0), F.abs(places))
    times = _let(size * power, lambda x: _nearest(x, lambda: _lost(size, power, x)))
    over = _let(size / power, lambda x: _nearest(x, lambda: (size - x * power) - _lost(x, power, x * power)))
    return _let(F.when(places >= 0, times).otherwise(over), lambda m: F.when(m < 10**DIGITS, _text(m.cast("string"), e)).otherwise(_text(F.lit("1" + "0" * (DIGITS - 1)), e + 1)))


def _text(digits: Column, e: Column) -> Column:
    """Six digits, the first of which counts 10^e."""
    plain = F.when(e >= 0, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(DIGITS))))
    plain = plain.otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    exponent = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    science = F.concat(_strip(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, DIGITS))), exponent)
    return F.when((e >= LEAST) & (e < MOST), _strip(plain)).otherwise(science)


def _science(size: Column) -> Column:
    text = F.format_string(f"%.{DIGITS - 1}e", size)
    return F.concat(_strip(F.substring_index(text, "e", 1)), F.lit("e"), F.substring_index(text, "e", -1))
