"""Date text of link exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import strip

# Month abbreviations (fixed values).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a calendar date, NULL when there is no such date."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (year != "0000"), text.try_cast("date").cast("string"))


def _parts(text: Column, pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
    month_text = F.regexp_extract(text, pattern, month)
    if named:
        number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month_text))
        month_text = number.cast("string")
    return _iso(F.regexp_extract(text, pattern, year), month_text, F.regexp_extract(text, pattern, day))


def normalise_date(value: Column) -> Column:
    """ISO date where the text can be read as one, else the trimmed text.

    A text that starts year first is never tried in the other layouts.
    """
    text = F.coalesce(strip(value), F.lit(""))
    names = "|".join(MONTHS)
    year_first = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    return F.when(text.rlike(year_first), F.coalesce(_parts(text, year_first, 1, 2, 3), text)).otherwise(
        F.coalesce(
            _parts(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
            _parts(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
            _parts(text, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1),
            _parts(text, rf"(?i)^({names})\s+(\d{{1,2}}),\s+(\d{{4}})$", 3, 1, 2, named=True),
            _parts(text, rf"(?i)^(\d{{1,2}})\s+({names})\s+(\d{{4}})$", 3, 2, 1, named=True),
            text,
        )
    )


def year_of(text: Column) -> Column:
    """First four characters if they are digits, else NULL."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit(""))
