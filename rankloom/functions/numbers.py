"""Lenient number parsing, guarded arithmetic and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import strip

# Decimal literals only: a bare cast would also take Java forms such as "1d" or "0x1p3".
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def _parsed(text: Column) -> Column:
    """Finite double, or NULL."""
    clean = strip(text)
    value = F.when(clean.rlike(NUMBER), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def lenient_double(text: Column, default: float | None = 0.0) -> Column:
    parsed = _parsed(text)
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def lenient_int(text: Column, default: int = 0) -> Column:
    """Number truncated toward zero; anything unreadable gives ``default``."""
    return F.coalesce(_parsed(text).try_cast("bigint"), F.lit(default).cast("bigint"))


def grouped_double(text: Column, default: float | None = 0.0) -> Column:
    """As :func:`lenient_double`, thousands separators allowed."""
    return lenient_double(F.replace(text, F.lit(","), F.lit("")), default)


def grouped_int(text: Column, default: int = 0) -> Column:
    return lenient_int(F.replace(text, F.lit(","), F.lit("")), default)


def metric_double(text: Column) -> Column:
    """Optional metric: separators and percent signs dropped, unreadable means unknown (NULL)."""
    return lenient_double(F.regexp_replace(text, "[,%]", ""), None)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` and 0 for an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


#: Whole digits that a value may have in an exact sum; a decimal's other digits are room for the sum itself.
WHOLE_DIGITS = 24


def exact(value: Column, scale: int = 6) -> Column:
    """Decimal view of a double, so that sums do not depend on the order of the rows. NULL from 1e24 on: such a value is left out
    of the sum and counted by :func:`unsummed`."""
    return value.cast("double").try_cast(f"decimal({WHOLE_DIGITS + scale},{scale})").cast(f"decimal(38,{scale})")


def exact_sum(value: Column, scale: int = 6) -> Column:
    """Sum of the values that :func:`exact` holds; NULL where the sum itself has too many digits."""
    return F.try_sum(exact(value, scale))


def unsummed(value: Column, scale: int = 6) -> Column:
    """How many values are too large for :func:`exact_sum`."""
    return F.count_if(value.isNotNull() & exact(value, scale).isNull())


def half_up(value: Column, digits: int) -> Column:
    """Round half up on the decimal value; the result is a double again. From 1e17 on a double has no fraction to round."""
    number = value.cast("double")
    return F.when(F.abs(number) < F.lit(1e17), F.round(value.cast("decimal(28,10)"), digits).cast("double")).otherwise(number)


def whole_even(value: Column) -> Column:
    """Text of a double without fraction, halves to the even neighbour."""
    return F.bround(value, 0).cast("bigint").cast("string")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for output; rules and scores always read the unrounded values."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(
        *[half_up(F.col(name), digits).alias(name) if name in doubles else F.col(name) for name in df.columns]
    )
