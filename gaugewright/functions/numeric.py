"""Small expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed hours, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", start, end) / 3.6e9 if isinstance(start, Column) else F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 3.6e9


def add_hours(ts: Column, hours: Column) -> Column:
    """A timestamp some hours later, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(hours * 3.6e9).cast("long"), ts)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def log10_or_zero(x: Column) -> Column:
    """log10, with 0 where it is not defined."""
    return F.coalesce(F.log10(x), F.lit(0.0))


def slope_line(x: Column, mean_x: Column, mean_y: Column, slope: float) -> Column:
    """The line of a slope through a mean point."""
    return slope * (x - mean_x) + mean_y


def last_nonzero(values: Column) -> Column:
    """The last entry of an array that is not 0; null if there is none."""
    return F.try_element_at(F.filter(values, lambda v: v != 0), F.lit(-1))
