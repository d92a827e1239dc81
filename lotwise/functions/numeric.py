"""Column helpers: ratios that never raise, rounding, formatting, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a, b)


def even(x: Column | str, digits: int) -> Column:
    """Rounded half-even after scaling, as numpy rounds."""
    scale = float(10**digits)
    return F.rint((F.col(x) if isinstance(x, str) else x) * scale) / scale


def exact_sum(x: Column) -> Column:
    """Sum of money amounts that does not depend on the order of rows."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def money(x: Column) -> Column:
    """Rounded to cents."""
    return even(x, 2)


def as_number(x: Column) -> Column:
    """A double, NULL for anything that isn't one or is NaN."""
    return F.nullif(F.col(x).try_cast("double") if isinstance(x, str) else x.try_cast("double"), F.lit(float("nan")))


def currency(x: Column) -> Column:
    """$1,234.50; the sign stands after the dollar."""
    return F.format_string("$%,.2f", money(x))


def whole_currency(x: Column) -> Column:
    """$1,235."""
    return F.format_string("$%,.0f", even(x, 0))


def percent(x: Column) -> Column:
    """12.35% of a value in percent."""
    return F.format_string("%.2f%%", even(x, 2))


def percent_of_one(x: Column, digits: int) -> Column:
    """12.3% or 12.35% of a fraction, 0.1235."""
    return F.format_string(f"%.{digits}f%%", even(x * 100, digits))


def signed(x: Column) -> Column:
    """With an explicit plus if not negative."""
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.2f", even(x, 2)))


def gain_class(x: Column) -> Column:
    """Zero is a loss."""
    return F.when(x > 0, "gain").otherwise("loss")


def display_time(ts: Column, zone: str = "+07:00") -> Column:
    """A UTC time as text in a fixed zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")
