"""Score expressions. Weights are decimals, so a score is exact and rounds half up."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.ladders import at_least, at_most, below
from rankloom.functions.numbers import clamp, half_up

SPAM_SCORE = -100.0


def _weight(text: str) -> Column:
    return F.lit(Decimal(text))


# Step tables (fixed values).
OVERLAP_STEPS = ((7, 100), (6, 90), (5, 80), (4, 70), (3, 55), (2, 35))
RATING_STEPS = ((80, 100), (60, 80), (40, 60), (20, 40))
TRAFFIC_STEPS_V1 = ((100000, 100), (50000, 90), (10000, 70), (1000, 50))
TRAFFIC_STEPS_V2 = ((50, 70), (500, 80), (5000, 90))
KEYWORD_OVERLAP_STEPS = ((5, 100), (4, 85), (3, 70), (2, 40))
KEYWORD_DIFFICULTY_STEPS = ((10, 100), (20, 90), (35, 75), (50, 50), (70, 20))
KEYWORD_VOLUME_STEPS = ((10000, 100), (5000, 85), (1000, 70), (500, 50), (100, 30))
CPC_STEPS = ((2.0, 15), (1.0, 10), (0.5, 5))
ALPHA_STEPS = ((7, 100), (6, 92), (5, 84), (4, 72), (3, 58), (2, 40))
ORGANIC_STEPS = ((50, 55), (500, 70), (5000, 82), (50000, 92))


def overlap_points(alpha: Column) -> Column:
    return at_least(alpha, OVERLAP_STEPS, 15)


def rating_points(rating: Column) -> Column:
    return at_least(rating, RATING_STEPS, 20)


def traffic_points_v1(traffic: Column) -> Column:
    return at_least(traffic, TRAFFIC_STEPS_V1, 20)


def traffic_points_v2(traffic: Column) -> Column:
    return F.when(traffic == 0, 0).otherwise(below(traffic, TRAFFIC_STEPS_V2, 100))


def link_score_v1(alpha: Column, rating: Column, traffic: Column, dofollow: Column, spam: Column) -> Column:
    points = (
        overlap_points(alpha) * _weight("0.35")
        + rating_points(rating) * _weight("0.30")
        + traffic_points_v1(traffic) * _weight("0.15")
        + F.when(dofollow, 20).otherwise(0)
    )
    return F.when(spam, SPAM_SCORE).otherwise(half_up(points, 1))


def link_score_v2(alpha: Column, rating: Column, traffic: Column, dofollow: Column, spam: Column) -> Column:
    points = (
        overlap_points(alpha) * _weight("0.15")
        + rating_points(rating) * _weight("0.40")
        + traffic_points_v2(traffic) * _weight("0.25")
        + F.when(dofollow, 20).otherwise(0)
        + F.when(traffic > 0, 10).otherwise(0)
    )
    return F.when(spam, SPAM_SCORE).otherwise(F.least(half_up(points, 1), F.lit(100.0)))


def keyword_score(alpha: Column, kd: Column, volume: Column, cpc: Column) -> Column:
    points = (
        at_most(kd, KEYWORD_DIFFICULTY_STEPS, 0) * _weight("0.40")
        + at_least(alpha, KEYWORD_OVERLAP_STEPS, 15) * _weight("0.30")
        + at_least(volume, KEYWORD_VOLUME_STEPS, 10) * _weight("0.30")
        + at_least(cpc, CPC_STEPS, 0)
    )
    return F.least(half_up(points, 1), F.lit(100.0))


def new_site_keyword_score(volume: Column, kd: Column, cpc: Column, buying_intent: Column) -> Column:
    """Score for a site without authority: difficulty decides, volume and value only add to it."""
    ease = (
        F.when(kd > 40, 15).when(kd > 25, 45).when(kd > 15, 65).when(kd >= 5, 85).otherwise(95)
    )
    reach = F.when(ease >= 60, at_least(volume, ((5000, 15), (1000, 10), (300, 5)), 0)).otherwise(0)
    value = F.when(buying_intent, 10).otherwise(0) + at_least(cpc, ((1.0, 10), (0.5, 5)), 0)
    return F.when(volume < 30, 0).otherwise(F.least(ease + reach + value, F.lit(100)))


def alpha_points(alpha: Column) -> Column:
    return at_least(alpha, ALPHA_STEPS, 20)


def organic_points(traffic: Column) -> Column:
    """NULL (unknown) stays NULL and is not the same as no traffic."""
    return F.when(
        traffic.isNotNull(), F.when(traffic <= 0, 0).otherwise(below(traffic, ORGANIC_STEPS, 100))
    )


def visits_points(visits: Column) -> Column:
    grown = clamp(F.lit(20.0) + F.lit(20.0) * F.log10(F.greatest(visits, F.lit(0.0)) + 1))
    return F.when(visits.isNotNull(), F.when(visits <= 0, F.lit(0.0)).otherwise(grown))


# Parts of the acquisition score: (name, weight) (fixed values).
MACHINE_WEIGHTS = (
    ("Authority", "0.30"),
    ("Alpha", "0.20"),
    ("Live", "0.12"),
    ("Follow", "0.10"),
    ("Avg Page AS", "0.08"),
    ("High Page AS", "0.05"),
    ("Organic Traffic", "0.10"),
    ("Monthly Visits", "0.05"),
)


def machine_parts() -> dict[str, Column]:
    """Parts of the acquisition score over the columns of a domain summary, each 0..100 or NULL."""
    c = F.col
    parts = {
        "Authority": clamp(F.coalesce(c("domain_authority_score"), c("max_page_as").cast("double"))),
        "Alpha": alpha_points(c("alpha")),
        "Live": clamp(c("live_rate") * 100),
        "Follow": clamp(c("live_follow_rate") * 100),
        "Avg Page AS": clamp(c("live_avg_page_as")),
        "High Page AS": clamp(c("high_page_as_rate") * 100),
        "Organic Traffic": organic_points(c("organic_traffic")),
        "Monthly Visits": visits_points(c("monthly_visits")),
    }
    return {name: part.cast("decimal(20,8)") for name, part in parts.items()}


def machine_penalty() -> Column:
    c = F.col
    return (
        at_least(c("sitewide_rate"), ((0.50, 8), (0.20, 4)), 0)
        + at_least(c("sponsored_rate"), ((0.50, 6), (0.20, 3)), 0)
        + F.when(c("ugc_rate") >= 0.70, 4).otherwise(0)
        + F.when(c("live_backlinks") == 0, 8).otherwise(0)
    )


def machine_score() -> Column:
    """Weighted mean of the known parts minus penalties: an unknown part also leaves the denominator."""
    total, weights, parts = F.lit(Decimal("0")), F.lit(Decimal("0")), machine_parts()
    for name, weight in MACHINE_WEIGHTS:
        part = parts[name]
        total = total + F.coalesce(part, F.lit(Decimal("0"))) * _weight(weight)
        weights = weights + F.when(part.isNotNull(), _weight(weight)).otherwise(_weight("0.00"))
    mean = total.cast("double") / weights.cast("double")
    return half_up(clamp(mean - machine_penalty()), 1)


def machine_breakdown() -> Column:
    """Known parts and the penalty as one line of text."""
    parts = machine_parts()
    shown = [
        F.when(
            parts[name].isNotNull(),
            F.concat(
                F.lit(f"{name}="),
                F.bround(parts[name], 0).cast("bigint").cast("string"),
                F.lit(f"×{int(Decimal(weight) * 100)}%"),
            ),
        )
        for name, weight in MACHINE_WEIGHTS
    ]
    penalty = machine_penalty()
    return F.concat_ws(
        "; ", *shown, F.when(penalty > 0, F.concat(F.lit("Penalty=-"), penalty.cast("string")))
    )


def written_score(text: Column) -> Column:
    """A score that somebody wrote into a hand-off column; null while it is blank or no number."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def blend_two(machine: Column, manual: Column) -> Column:
    """0.85 machine + 0.15 manual, a missing manual score counts as 0."""
    return half_up(machine * 0.85 + F.coalesce(manual, F.lit(0.0)) * 0.15, 4)


def blend_three(machine: Column, relevance: Column, difficulty: Column) -> Column:
    return half_up(
        machine * 0.8 + F.coalesce(relevance, F.lit(0.0)) * 0.15 + F.coalesce(difficulty, F.lit(0.0)) * 0.05, 4
    )


def blend_or_machine(machine: Column, relevance: Column) -> Column:
    """0.9 machine + 0.1 relevance; without a relevance the machine score stands as it is."""
    return F.when(relevance.isNull(), machine).otherwise(half_up(machine * 0.9 + relevance * 0.1, 4))
