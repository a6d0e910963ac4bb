"""Column helpers for the places where the warehouse dialect and Spark differ.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def one_of(column: str, values: Iterable[str]) -> Column:
    """``column IN (...)``, parsed once: a literal per call is slow for long lists."""
    listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"`{column}` IN ({listed})")


def any_like(text: Column, patterns: Iterable[str]) -> Column:
    """Whole-string alternatives with ``%`` wildcards (the dialect's SIMILAR TO)."""
    return any_of(text.like(p) for p in patterns)


def matches(text: Column, regex: str) -> Column:
    """Unanchored, case-insensitive regular expression; null stays null."""
    return text.rlike(f"(?i){regex}")


def ends_with_plus(text: Column) -> Column:
    """The dialect's LIKE with an escaped plus; Spark rejects that escape."""
    return text.endswith("+")


def drop_plus(text: Column) -> Column:
    return F.replace(text, F.lit("+"), F.lit(""))


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def month_diff(start: Column, end: Column) -> Column:
    """Month boundaries crossed: 31 January to 1 February is 1."""
    return month_number(end) - month_number(start)


def day_diff(start: Column, end: Column) -> Column:
    """Calendar days from start to end, whatever the time of day."""
    return F.datediff(F.to_date(end), F.to_date(start))


def first_match(rules: Iterable[tuple[Column, Column | str | int]], otherwise: Column | str | None = None) -> Column:
    """Ordered CASE: the first rule that holds wins; null when none does and no default."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def percent(part: Column, whole: Column) -> Column:
    """part * 100 / whole as double; null when whole is 0."""
    return F.when(whole != 0, part.cast("double") * 100.0 / whole.cast("double"))
