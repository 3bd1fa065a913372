"""Vendor A link facts (one row per competitor and referring domain): profiles, trends, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.dates import year_of
from rankloom.functions.ladders import RATING_BANDS, RATING_TOP, rating_band
from rankloom.functions.numbers import half_up, ratio
from rankloom.functions.text import bind, breadcrumb_leaf, breadcrumb_root, first_filled, joined, strip
from rankloom.operators.ranking import running_totals, yearly_grid

BANDS = [label for _, label in RATING_BANDS] + [RATING_TOP]


def _band_name(label: str, prefix: str = "") -> str:
    return f"{prefix}dr_{label.replace('-', '_')}"


def _count(test: Column) -> Column:
    return F.count_if(test).cast("bigint")


def competitor_profile(links: DataFrame) -> DataFrame:
    """Counts per competitor, for all links and for those still live, in one pass."""
    live = ~F.col("is_lost")
    band = rating_band(F.col("domain_rating"))
    measures = []
    for prefix, scope in (("", F.lit(True)), ("live_", live)):
        measures += [
            _count(scope).alias(f"{prefix}domains"),
            F.sum(F.when(scope, F.col("links_in_group")).otherwise(0)).alias(f"{prefix}links"),
            _count(scope & F.col("is_dofollow")).alias(f"{prefix}dofollow"),
            _count(scope & F.col("is_spam")).alias(f"{prefix}spam"),
        ]
        measures += [_count(scope & (band == label)).alias(_band_name(label, prefix)) for label in BANDS]
    return links.groupBy("competitor_domain").agg(*measures)


def competitor_shares(profile: DataFrame) -> DataFrame:
    """Rates derived from :func:`competitor_profile`; competitors without domains are left out."""
    c = F.col
    columns = {
        "lost_rate": ratio(c("domains") - c("live_domains"), c("domains")),
        "live_dofollow_share": ratio(c("live_dofollow"), c("live_domains")),
        "links_per_domain": ratio(c("links"), c("domains")),
        "live_links_per_domain": ratio(c("live_links"), c("live_domains")),
        "dofollow_share": ratio(c("dofollow"), c("domains")),
        "spam_share": ratio(c("spam"), c("domains")),
        "live_spam_share": ratio(c("live_spam"), c("live_domains")),
    }
    for prefix in ("", "live_"):
        high = sum((c(_band_name(label, prefix)) for label in BANDS[3:]), c(_band_name(BANDS[2], prefix)))
        columns[f"{prefix}high_rating_share"] = ratio(high, c(f"{prefix}domains"))
        for label in BANDS:
            name = _band_name(label, prefix)
            columns[f"{name}_share"] = ratio(c(name), c(f"{prefix}domains"))
    return profile.filter(c("domains") > 0).select(
        "competitor_domain", *[half_up(value, 6).alias(name) for name, value in columns.items()]
    )


def links_by_year(links: DataFrame) -> DataFrame:
    """Domains first seen per competitor and year, all and live; undated links are not counted."""
    return (
        links.select("competitor_domain", year_of(F.col("first_seen")).alias("year"), "is_lost")
        .filter(F.col("year").isNotNull())
        .groupBy("competitor_domain", "year")
        .agg(F.count(F.lit(1)).alias("n_new"), _count(~F.col("is_lost")).alias("n_new_live"))
    )


def cumulative_by_year(links: DataFrame) -> DataFrame:
    """Zero-filled yearly counts with their running totals."""
    measures = ["n_new", "n_new_live"]
    grid = yearly_grid(links_by_year(links), "competitor_domain", "year", measures)
    return running_totals(grid, "competitor_domain", "year", measures)


def matrix_detail() -> Column:
    written = bind(
        F.from_json(F.col("raw_json"), "map<string,string>"),
        lambda fields: F.coalesce(*[F.element_at(fields, F.lit(key)) for key in rules.ANCHOR_KEYS_MATRIX]),
    )
    anchor = first_filled(strip(written), default=F.lit(rules.NO_ANCHOR))
    return F.format_string(
        "[%s] %s  --[%s]-->  %s", F.col("competitor_domain"), F.col("ref_url"), anchor, F.col("target_url")
    )


def per_competitor(links: DataFrame) -> DataFrame:
    """Links of one referring domain and competitor folded into one row.

    Facts are unique on this pair, so no row moves: the pair is the key they were de-duplicated on. A domain
    has at most as many rows as there are competitors, and one link reference for each of them; all
    references are rows of :func:`overlap_details`.
    """
    known_type = F.when((F.col("page_type") != "") & (F.col("page_type") != "Unknown"), F.col("page_type"))
    known_class = F.when(
        (F.col("page_category") != "") & (F.col("page_category") != "Unknown"), F.col("page_category")
    )
    return links.groupBy("ref_domain", "competitor_domain").agg(
        F.sum("links_in_group").alias("links"),
        F.max("domain_rating").alias("rating"),
        F.max("page_traffic").alias("traffic"),
        F.bool_or("is_dofollow").alias("dofollow"),
        F.bool_or("is_spam").alias("any_spam"),
        F.bool_and("is_spam").alias("all_spam"),
        F.min(breadcrumb_leaf(known_type)).alias("format"),
        F.min(breadcrumb_root(known_class)).alias("industry"),
        F.min(matrix_detail()).alias("detail"),
    )


def domain_overlap(links: DataFrame, threshold: int = 1) -> DataFrame:
    """Referring domains by the number of competitors they link to."""
    return (
        per_competitor(links)
        .groupBy("ref_domain")
        .agg(
            F.count(F.lit(1)).alias("alpha"),
            F.sum("links").alias("total_links"),
            F.greatest(F.max("rating"), F.lit(0).cast("bigint")).alias("max_dr"),
            F.greatest(F.max("traffic"), F.lit(0).cast("bigint")).alias("max_traffic"),
            F.bool_or("dofollow").alias("any_dofollow"),
            F.bool_and("all_spam").alias("all_spam"),
        )
        .filter(F.col("alpha") >= threshold)
    )


def overlap_matrix(links: DataFrame, threshold: int = 1) -> DataFrame:
    """Ranked overlap matrix with labels, competitors and link references."""
    c = F.col
    return (
        per_competitor(links)
        .groupBy("ref_domain")
        .agg(
            F.count(F.lit(1)).alias("alpha"),
            F.sum("links").alias("total_links"),
            F.greatest(F.max("rating"), F.lit(0).cast("bigint")).alias("max_dr"),
            F.greatest(F.max("traffic"), F.lit(0).cast("bigint")).alias("max_traffic"),
            F.coalesce(F.min("industry"), F.lit(rules.DEFAULT_INDUSTRY)).alias("industry"),
            F.coalesce(F.min("format"), F.lit(rules.DEFAULT_FORMAT)).alias("content_format"),
            joined(F.collect_list("competitor_domain"), ", ").alias("shared_by"),
            F.bool_and("all_spam").alias("is_spam"),
            F.bool_or("dofollow").alias("is_dofollow"),
            joined(F.collect_list("detail"), "\n").alias("link_refs"),
        )
        .filter(c("alpha") >= threshold)
        .orderBy(
            c("is_spam").asc(),
            c("is_dofollow").desc(),
            c("alpha").desc(),
            c("max_dr").desc(),
            c("max_traffic").desc(),
            c("ref_domain"),
        )
    )


def top_overlap(matrix: DataFrame, n: int) -> DataFrame:
    """The best ``n`` rows of the overlap matrix; only they are kept while sorting."""
    return matrix.limit(n)


def overlap_details(links: DataFrame) -> DataFrame:
    """Every link with the overlap of its referring domain (1 when unknown)."""
    alpha = domain_overlap(links).select("ref_domain", "alpha")
    return links.join(alpha, "ref_domain", "left").withColumn("alpha", F.coalesce("alpha", F.lit(1).cast("bigint")))


def content_briefs(matrix: DataFrame, keyword: str) -> DataFrame:
    """Writing brief per shared domain (rows of the overlap payload)."""
    text = rules.BRIEF_TEXT.replace("{keyword}", keyword)
    pattern = text.replace("{industry}", "%1$s").replace("{format}", "%2$s").replace("{rating}", "%3$s")
    return matrix.select(
        F.col("ref_domain").alias("target_domain"),
        F.col("alpha").alias("overlap_alpha_score"),
        F.col("max_dr").alias("domain_rating"),
        F.format_string(pattern, F.col("industry"), F.col("content_format"), F.col("max_dr").cast("string")).alias(
            "agent_prompt"
        ),
    )
