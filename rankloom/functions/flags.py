"""Boolean readings of export columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import strip

LOOSE_TRUE = ("true", "1", "yes", "y", "t")


def strict_true(text: Column) -> Column:
    """TRUE in any case, nothing else."""
    return F.coalesce(F.upper(text) == "TRUE", F.lit(False))


def dofollow(nofollow: Column) -> Column:
    """A link is dofollow unless its nofollow column says TRUE."""
    return ~strict_true(nofollow)


def loose_true(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin(*LOOSE_TRUE), F.lit(False))


def lost(text: Column) -> Column:
    """Any visible text in the lost column means the link is gone."""
    return F.coalesce(strip(text) != "", F.lit(False))


def follows(nofollow: Column, sponsored: Column, ugc: Column) -> Column:
    """Clean link: none of the three attributes."""
    return ~(nofollow | sponsored | ugc)
