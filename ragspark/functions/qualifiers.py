"""Search strings with qualifiers (``stars:>=10 language:Go "a phrase" -draft``) as conditions on columns.

A table says which qualifiers it knows: a name and a function from the value to a condition. Conditions on numbers, dates
and exact values are plain comparisons, so they reach the scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark.errors import ValidationError

Qualifier = Callable[[str], Column]
TERM = re.compile(r'(-?)(?:([A-Za-z_]+):)?("[^"]*"|[^\s"]+)')
RANGE = re.compile(r"(>=|<=|>|<)?(.+)")


def _compared(column: str, read: Callable[[str], object]) -> Qualifier:
    """``5``, ``>5``, ``>=5``, ``<5``, ``<=5``, ``5..9``, ``5..*``, ``*..9``."""

    def condition(value: str) -> Column:
        c = F.col(column)
        try:
            if ".." in value:
                low, high = value.split("..", 1)
                bounds = [c >= F.lit(read(low))] if low != "*" else []
                bounds += [c <= F.lit(read(high))] if high != "*" else []
                return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else c.isNotNull()
            sign, number = RANGE.fullmatch(value).groups()
            at = F.lit(read(number))
        except (ValueError, AttributeError) as e:
            raise ValidationError(f"{column} cannot be compared with {value!r}") from e
        return {">": c > at, ">=": c >= at, "<": c < at, "<=": c <= at, None: c == at}[sign]

    return condition


def number(column: str) -> Qualifier:
    return _compared(column, int)


def day(column: str) -> Qualifier:
    """Of a date column; days as YYYY-MM-DD."""
    return _compared(column, date.fromisoformat)


def exact(column: str) -> Qualifier:
    return lambda value: F.col(column) == value


def prefix(column: str) -> Qualifier:
    return lambda value: F.col(column).startswith(value)


def contains(*columns: str) -> Qualifier:
    """In the columns' texts, whatever the case."""
    return lambda value: F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(value.lower()))


def member(column: str) -> Qualifier:
    return lambda value: F.array_contains(column, value)


def matching(query: str, text: Qualifier, known: dict[str, Qualifier]) -> Column:
    """Whether a row fits every term of ``query``: a known qualifier its condition, anything else ``text``; a quoted
    term is one value, and a minus before a term wants rows that do not fit it (a null does not fit).

    Unknown qualifiers are text, colon included, as in ``http://a``; quotes without an end and empty quotes say nothing.
    A number or day that cannot be read is an error. An empty query fits all rows."""
    fits = F.lit(True)
    for minus, name, value in TERM.findall(query):
        value = value.strip('"')
        if value == "":
            continue
        condition = known[name](value) if name in known else text(f"{name}:{value}" if name else value)
        fits = fits & (~F.coalesce(condition, F.lit(False)) if minus else condition)
    return fits
