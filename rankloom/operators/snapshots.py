"""Site snapshots: what was added, removed and kept, and keyword phrases shared through URL slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import joined, single
from rankloom.functions.urls import any_www_host, page_url, slug_phrase
from rankloom.operators.ranking import top_per_group

KEY = ("site_id", "page_url")


def current_pages(crawled: DataFrame, site: str = "site_id", url: str = "url") -> DataFrame:
    """Distinct normalised pages of a crawl."""
    return (
        crawled.filter(F.col(url) != "")
        .select(F.col(site).alias("site_id"), page_url(F.col(url)).alias("page_url"))
        .distinct()
    )


def added(current: DataFrame, history: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return current.join(history.select(*key), list(key), "left_anti").select(*key)


def removed(current: DataFrame, history: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return history.join(current.select(*key), list(key), "left_anti").select(*key)


def changes(current: DataFrame, history: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Both differences from a single join, marked ``added`` or ``removed``."""
    now = current.select(*key).withColumn("_now", F.lit(True))
    then = history.select(*key).withColumn("_then", F.lit(True))
    return (
        now.join(then, list(key), "full_outer")
        .filter(F.col("_now").isNull() | F.col("_then").isNull())
        .select(*key, F.when(F.col("_now").isNull(), "removed").otherwise("added").alias("change"))
    )


def applied(current: DataFrame, history: DataFrame, seen_at: Column, key: Sequence[str] = KEY) -> DataFrame:
    """The next snapshot: current pages, survivors with the dates they had, new pages dated ``seen_at``."""
    dated = current.select(*key).join(history.select(*key, "first_seen", "last_seen"), list(key), "left")
    return dated.select(
        *key,
        F.coalesce(F.col("first_seen"), seen_at).alias("first_seen"),
        F.coalesce(F.col("last_seen"), seen_at).alias("last_seen"),
    )


def slug_keywords(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages per keyword phrase and site domain; pages of an unlisted site belong to ``Unknown``."""
    named = sites.select("site_id", any_www_host(F.col("url")).alias("domain"))
    return (
        pages.select("site_id", "page_url", single(slug_phrase(F.col("page_url"))).alias("keyword"))
        .filter(F.col("keyword").isNotNull())
        .join(named, "site_id", "left")
        .select("keyword", F.coalesce("domain", F.lit("Unknown")).alias("domain"), "page_url")
    )


def slug_overlap(pages: DataFrame, sites: DataFrame, links_per_site: int = 2) -> DataFrame:
    """Keyword phrases by the number of site domains using them, with sample pages per domain.

    With two or more sites a phrase of a single domain is left out.
    """
    c = F.col
    found = slug_keywords(pages, sites)
    pair = ["keyword", "domain"]
    samples = (
        top_per_group(found, pair, ["page_url"], links_per_site)
        .groupBy(*pair)
        .agg(F.sort_array(F.collect_list(F.concat(F.lit("["), "domain", F.lit("] "), "page_url"))).alias("links"))
    )
    n_sites = sites.agg(F.count(F.lit(1))).scalar()
    return (
        samples.groupBy("keyword")
        .agg(
            F.count(F.lit(1)).alias("alpha"),
            joined(F.collect_list("domain"), ", ").alias("shared_by"),
            F.array_join(F.sort_array(F.flatten(F.collect_list("links"))), "\n").alias("links"),
        )
        .filter((c("alpha") >= 2) | (n_sites < 2))
        .orderBy(F.desc("alpha"), "keyword")
    )


def run_summary(pages: DataFrame, sites: DataFrame, run_at: Column) -> DataFrame:
    """One-row summary of a run: sites analysed and keyword phrases found."""
    n_sites = sites.agg(F.count(F.lit(1))).scalar()
    return (
        pages.select(slug_phrase(F.col("page_url")).alias("keyword"))
        .agg(F.count_distinct("keyword").alias("total_keywords_extracted"))
        .select(
            F.lit("pseo_reverse_engineering_complete").alias("event_type"),
            run_at.alias("timestamp"),
            n_sites.alias("sites_analyzed"),
            "total_keywords_extracted",
        )
    )
