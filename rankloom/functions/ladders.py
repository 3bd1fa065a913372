"""Step functions: bands, tiers and levels read from threshold tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import rules


def _steps(tests: Iterable[tuple[Column, object]], otherwise) -> Column:
    chain: Callable = F.when
    result = None
    for test, value in tests:
        result = chain(test, value)
        chain = result.when
    return result.otherwise(otherwise)


def at_least(value: Column, steps, otherwise) -> Column:
    return _steps(((value >= bound, result) for bound, result in steps), otherwise)


def at_most(value: Column, steps, otherwise) -> Column:
    return _steps(((value <= bound, result) for bound, result in steps), otherwise)


def below(value: Column, steps, otherwise) -> Column:
    return _steps(((value < bound, result) for bound, result in steps), otherwise)


# Band edges (fixed values).
RATING_BANDS = ((20, "0-20"), (40, "20-40"), (60, "40-60"), (80, "60-80"))
RATING_TOP = "80-100"
AUTHORITY_BANDS = (("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-100", 81, 100))
HEAT_STEPS = ((1000, "🔥🔥🔥"), (100, "🔥"), (10, "🌟"))
HEAT_LAST = "⭐"
LINK_KINDS = ("Image", "Form", "Frame", "Text", "Unknown")


def rating_band(rating: Column) -> Column:
    return at_most(rating, RATING_BANDS, RATING_TOP)


def authority_band(score: Column) -> Column:
    """Band with whole-number edges: a value between two bands counts as the lowest one."""
    found = _steps(
        ((score.between(low, high), label) for label, low, high in AUTHORITY_BANDS),
        None,
    )
    return F.coalesce(found, F.when(score > 100, F.lit("81-100")), F.lit("0-20"))


def rank_band(position: Column) -> Column:
    return at_most(position, ((3, "1-3"), (10, "4-10"), (20, "11-20")), "21+")


def difficulty_band(kd: Column) -> Column:
    return at_most(kd, ((15, "0-15"), (40, "16-40")), "41+")


def heat(traffic: Column) -> Column:
    """Traffic tier of a tree node, on the whole part of the traffic; empty without traffic."""
    whole = F.floor(traffic)
    return F.when(traffic > 0, at_least(whole, HEAT_STEPS, HEAT_LAST)).otherwise("")


def link_kind(image: Column, form: Column, frame: Column, text: Column) -> Column:
    return _steps(zip((image, form, frame, text), LINK_KINDS), LINK_KINDS[-1])


def priority_label(priority: Column) -> Column:
    return _steps(((priority == key, text) for key, text in rules.PRIORITY_LABELS.items()), None)


def priority_rank(priority: Column) -> Column:
    return _steps(((priority == key, rank) for key, rank in rules.PRIORITY_RANKS.items()), None)


def enrichment_status(authority: Column, visits: Column, traffic: Column) -> Column:
    return (
        F.when(authority.isNull() & visits.isNull() & traffic.isNull(), rules.ENRICHMENT_NONE)
        .when(traffic.isNull(), rules.ENRICHMENT_PARTIAL)
        .otherwise(rules.ENRICHMENT_FULL)
    )


def level(value: Column, table) -> Column:
    steps, top = table
    return below(value, steps, top)
