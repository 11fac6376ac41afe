"""Lenient parsing of request values, and byte sizes for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a plain trim removes.
BLANKS = " \t\n\r\x00\x0b"
_LEADING_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_LONG_LIMIT = 9223372036854775807
_SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lenient_float(text: Column) -> Column:
    """The number a text starts with; blanks are ignored and a comma is a decimal point.

    Anything else, null included, is 0.
    """
    compact = F.replace(F.replace(trimmed(text), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(F.regexp_extract(compact, _LEADING_NUMBER, 0).try_cast("double"), F.lit(0.0))


def lenient_int(text: Column) -> Column:
    """Like :func:`lenient_float` without the comma rule, cut to a whole number.

    Values beyond 64 bits stop at the largest or smallest one.
    """
    number = F.regexp_extract(F.replace(trimmed(text), F.lit(" "), F.lit("")), _LEADING_NUMBER, 0)
    approximate = number.try_cast("double")
    cut = (
        F.when(approximate >= float(_LONG_LIMIT), F.lit(_LONG_LIMIT))
        .when(approximate <= -float(_LONG_LIMIT), F.lit(-_LONG_LIMIT - 1))
        .otherwise(approximate.try_cast("long"))
    )
    is_whole = number.rlike(r"^[+-]?[0-9]+$")
    exact = F.when(is_whole, number.try_cast("long"))
    return F.coalesce(exact, cut, F.lit(0).cast("long"))


def lenient_boolean(text: Column) -> Column:
    """Null when absent; ``false``, an empty text and ``0`` are false, the rest is true."""
    value = trimmed(text)
    return F.when(text.isNotNull(), ~value.isin("false", "", "0"))


def human_bytes(size: Column) -> Column:
    """Size with two decimals and a unit of 1024 steps; ``0`` for 0, null below 0.

    The unit comes from a floating-point logarithm, so sizes a hair below a step already
    show the next unit.
    """
    value = size.cast("double")
    power = F.floor(F.log(1024.0, value)).cast("int")
    scaled = F.round(value / F.pow(F.lit(1024.0), power), 2).cast("string")
    plain = F.regexp_replace(scaled, r"\.0$", "")
    units = F.array(*(F.lit(unit) for unit in _SIZE_UNITS))
    text = F.concat(plain, F.lit(" "), F.get(units, power))
    return F.when(value == 0, F.lit("0")).when(value > 0, text)
