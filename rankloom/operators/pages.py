"""Page facts: competitor profiles, page classes, top pages, sitemap reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import exact_sum, half_up, ratio
from rankloom.functions.urls import canonical_key, first_directory
from rankloom.operators.ranking import first_wins, highest_per_key, top_per_group, with_group_total


def page_profile(pages: DataFrame) -> DataFrame:
    """Totals per competitor; competitors without traffic are left out."""
    return (
        pages.groupBy("competitor_domain")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.sum("current_traffic").alias("traffic"),
            half_up(exact_sum(F.col("current_traffic_value")), 2).alias("traffic_value"),
            F.sum("current_ref_domains").alias("ref_domains"),
        )
        .filter(F.col("traffic") != 0)
        .withColumn("ref_domains_per_page", half_up(ratio(F.col("ref_domains"), F.col("n_pages")), 1))
    )


def class_rollup(pages: DataFrame) -> DataFrame:
    """Pages and traffic per competitor and page class, with the share of the competitor."""
    c = F.col
    classes = pages.groupBy("competitor_domain", "page_category").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("current_traffic").alias("traffic")
    )
    return (
        with_group_total(classes, ["competitor_domain"], "traffic", "_total")
        .filter(c("_total") != 0)
        .withColumns(
            {
                "traffic_share": half_up(ratio(c("traffic"), c("_total")), 6),
                "traffic_per_page": half_up(ratio(c("traffic"), c("n_pages")), 1),
            }
        )
        .drop("_total")
        .orderBy("competitor_domain", F.desc("traffic"), "page_category")
    )


def top_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    """Strongest pages with traffic of every competitor."""
    return top_per_group(
        pages.filter(F.col("current_traffic") > 0),
        ["competitor_domain"],
        [F.desc("current_traffic"), "page_url"],
        n,
    ).select(
        "competitor_domain",
        "page_url",
        "page_category",
        "current_traffic",
        "current_keywords",
        "top_keyword",
        "top_keyword_volume",
        "top_keyword_position",
    )


def page_opportunities(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages of all competitors, strongest first; ``limit`` cuts the table for a sheet."""
    ordered = pages.orderBy(F.desc("current_traffic"), F.asc("competitor_domain"), F.asc("page_url"))
    top = ordered.limit(limit) if limit else ordered
    return top.select(
        "competitor_domain",
        "page_category",
        "page_url",
        "top_keyword",
        "top_keyword_volume",
        "top_keyword_position",
        "current_ref_domains",
        "current_keywords",
        "current_traffic",
        "current_traffic_value",
    )


def reconcile(
    sitemap: DataFrame,
    metrics: DataFrame,
    sitemap_url: str = "sitemap_url",
    metrics_url: str = "metrics_url",
    by: Sequence[str] = ("domain",),
) -> DataFrame:
    """Sitemap URLs matched with page metrics on the canonical key, both sides kept.

    Each side is first reduced to one row per key: any sitemap URL, and the metrics row with the most
    traffic. Pages of all sites are matched in one job.
    """
    c = F.col
    key = [*by, "canonical_key"]
    listed = first_wins(
        sitemap.select(*by, c(sitemap_url).alias("sitemap_url"), canonical_key(c(sitemap_url)).alias("canonical_key")),
        key,
        ["sitemap_url"],
    )
    measured = highest_per_key(
        metrics.select(
            *by,
            c(metrics_url).alias("metrics_url"),
            "traffic",
            "keywords",
            "top_keyword",
            canonical_key(c(metrics_url)).alias("canonical_key"),
        ),
        key,
        "traffic",
        ["metrics_url"],
    )
    return listed.join(measured, key, "full_outer").select(
        *key,
        F.coalesce("metrics_url", "sitemap_url").alias("final_url"),
        F.coalesce("traffic", F.lit(0.0)).alias("traffic"),
        F.coalesce("keywords", F.lit(0.0)).alias("keywords"),
        "top_keyword",
        c("sitemap_url").isNotNull().alias("in_sitemap"),
    )


def page_health(merged: DataFrame) -> DataFrame:
    """Orphans (no traffic, not listed) and zombies (no traffic, listed)."""
    idle = F.col("traffic") == 0
    return merged.withColumns(
        {"is_orphan": idle & ~F.col("in_sitemap"), "is_zombie": idle & F.col("in_sitemap")}
    )


def directory_rollup(merged: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Pages and traffic per first-level directory."""
    return (
        merged.withColumn("dir_l1", first_directory(F.col("final_url")))
        .groupBy(*by, "dir_l1")
        .agg(F.count("final_url").alias("n_pages"), exact_sum(F.col("traffic")).cast("double").alias("traffic"))
        .orderBy(F.desc("traffic"), *by, "dir_l1")
    )


def traffic_pages(merged: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Pages with traffic, best first; a site without any gives all its pages instead."""
    visited = merged.filter(F.col("traffic") > 0)
    idle_sites = merged.join(visited.select(*by).distinct(), list(by), "left_anti")
    return visited.unionByName(idle_sites).orderBy(
        F.desc("traffic"), *by, "final_url"
    )
