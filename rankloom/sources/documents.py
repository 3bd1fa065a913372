"""URLs held in documents that were fetched before: sitemaps, robots files, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import strip
from rankloom.session import store

LOC = r"(?is)<(?:[a-z0-9]+:)?loc>(.*?)</(?:[a-z0-9]+:)?loc>"
HREF = r"(?i)\shref=\"([^\"]*)\""
ROBOTS_LINE = r"(?im)^Sitemap:[ \t]*(.*)$"
INDEX = r"(?i)<(?:[a-z0-9]+:)?sitemapindex|<sitemap>"


def _all(body: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), strip)


def is_index(body: Column) -> Column:
    return body.rlike(INDEX)


def sitemap_locations(documents: DataFrame) -> DataFrame:
    """Every location of every sitemap document, and whether the document is an index."""
    return documents.select(
        F.col("url").alias("sitemap_url"), is_index(F.col("body")).alias("is_index"), F.explode(_all(F.col("body"), LOC)).alias("loc")
    ).filter(F.col("loc") != "")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every link address of every page."""
    return pages.select(F.col(url).alias("page_url"), F.explode(_all(F.col(html), HREF)).alias("href"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemaps named by robots files; a site that names none has the usual one."""
    named = F.filter(_all(F.col("body"), ROBOTS_LINE), lambda s: s != "")
    usual = F.array(F.concat(F.col("site"), F.lit("/sitemap.xml")))
    return robots.select("site", F.explode(F.when(F.size(named) > 0, named).otherwise(usual)).alias("sitemap_url"))


@dataclass(frozen=True)
class SitemapWalk:
    """``sitemaps`` (site, sitemap_url, depth) that were reached, ``pages`` (site, page_url) that they list, and ``frontier``
    (site, sitemap_url): what indexes at the greatest depth name and was not followed."""

    sitemaps: DataFrame
    pages: DataFrame
    frontier: DataFrame


def walk_sitemaps(roots: DataFrame, documents: DataFrame, max_depth: int | None = None) -> SitemapWalk:
    """Follow the indexes from the root sitemaps, ``max_depth`` levels below the root or to the end.

    Bodies are parsed once, into a stored table of (sitemap, location). Each level is joined with it and keeps what its site has
    not visited yet, so indexes that name each other end the walk; a level is stored, and no plan grows with the depth.
    """
    found = store(sitemap_locations(documents))
    indexes = found.filter("is_index").select("sitemap_url", "loc")
    level = store(roots.select("site", "sitemap_url").distinct().withColumn("depth", F.lit(0)))
    visited, depth = level, 0
    while True:
        depth += 1
        named = level.join(indexes, "sitemap_url").select("site", F.col("loc").alias("sitemap_url")).distinct()
        level = store(named.join(visited, ["site", "sitemap_url"], "left_anti").withColumn("depth", F.lit(depth)))
        if (max_depth is not None and depth > max_depth) or level.isEmpty():
            break
        visited = store(visited.unionByName(level))
    leaves = found.filter(~F.col("is_index")).select("sitemap_url", F.col("loc").alias("page_url"))
    pages = visited.join(leaves, "sitemap_url").select("site", "page_url").distinct()
    return SitemapWalk(visited, pages, level.select("site", "sitemap_url"))


def expand_sitemaps(roots: DataFrame, documents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Page URLs reachable from the root sitemaps; see :func:`walk_sitemaps`."""
    return walk_sitemaps(roots, documents, max_depth).pages
