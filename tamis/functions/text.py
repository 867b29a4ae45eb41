"""Text forms of values, and texts as numbers, in SQL expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two numbers nearer than this are equal.
EPSILON = 2.0**-52
#: What counts as a number in text: no blanks around it, no type letter after it.
NUMBER = r"^[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"
_NUMBER = re.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.I)


def parsed(text: Column) -> Column:
    """Text as a double, or null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_number(text: str) -> float | None:
    return float(text) if _NUMBER.fullmatch(text) else None


def number_text(x: Column) -> Column:
    """A double in its shortest form that reads back: 25.5, 1.0, 1e20, 1.5e-7; plain from 1e-5 up to below 1e16."""
    s, size = x.cast("string"), F.abs(x)
    # A decimal made of a double has the double's shortest digits.
    plain = lambda kind: F.regexp_replace(x.cast(kind).cast("string"), "(\\.0|[1-9])0*\\z", "$1")
    far = F.replace(F.replace(s, F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e"))
    return F.when(F.isnan(x) | (size == math.inf), F.lit("null")).when(~F.contains(s, F.lit("E")), s).when((size >= 1e7) & (size < 1e16), plain("decimal(38,18)")).when((size >= 1e-5) & (size < 1e-3), plain("decimal(38,30)")).otherwise(far)


def number_words(x: float) -> str:
    """number_text for one number, for records decoded in Python."""
    if not math.isfinite(x):
        return "null"
    sign, digits, point = "-" if math.copysign(1, x) < 0 else "", *_shortest(abs(x))
    n = len(digits)
    if not x:
        return sign + "0.0"
    if n <= point <= 16:
        return sign + digits.ljust(point, "0") + ".0"
    if 0 < point <= 16:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{point - 1}"


def _shortest(x: float) -> tuple[str, int]:
    mantissa, power = f"{x!r}e0".split("e")[:2]
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    lead = len(whole.lstrip("0")) or -(len(fraction) - len(fraction.lstrip("0")))
    return digits.rstrip("0") or "0", lead + int(power)
