"""Readers of the four export kinds: links of two vendors, organic keywords, top pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.classify import page_class
from rankloom.functions.dates import normalise_date
from rankloom.functions.flags import dofollow, loose_true, lost, strict_true
from rankloom.functions.numbers import grouped_double, grouped_int, lenient_double, lenient_int
from rankloom.functions.text import strip
from rankloom.functions.urls import canonical_url, hostname, path, site_host
from rankloom.operators.imports import competitor_of_files, judged
from rankloom.operators.link_facts import registrable_domains
from rankloom.sources.exports import ExportFile, Fields, all_headers, inspect, list_files, read_exports

OVERVIEW_MARK = "overview-competitors"


def _before(name: Column, mark: str) -> Column:
    return F.substring_index(name, mark, 1)


def links_competitor(file_name: Column) -> Column:
    """Competitor in the name of a vendor A link export."""
    name = F.lower(file_name)
    return F.when(F.contains(name, F.lit("-backlinks")), _before(name, "-backlinks")).otherwise(
        F.replace(_before(name, "_"), F.lit(".csv"), F.lit(""))
    )


def keywords_competitor(file_name: Column) -> Column:
    return _before(F.lower(file_name), "-organic-positions")


def pages_competitor(file_name: Column) -> Column:
    name = F.lower(file_name)
    return (
        F.when(F.contains(name, F.lit("-top-pages")), _before(name, "-top-pages"))
        .when(F.contains(name, F.lit("_top_pages")), _before(name, "_top_pages"))
        .otherwise(_before(name, "."))
    )


def _vendor_a_links(rows: DataFrame, f: Fields) -> DataFrame:
    ref_url = f.filled("referring page url", "source url")
    return rows.filter(ref_url.isNotNull()).select(
        links_competitor(F.col("src_file")).alias("competitor_domain"),
        site_host(ref_url).alias("ref_domain"),
        ref_url.alias("ref_url"),
        f.text("target url").alias("target_url"),
        lenient_int(f.filled("domain rating", "dr")).alias("domain_rating"),
        lenient_int(f.filled("page traffic", "traffic")).alias("page_traffic"),
        f.text("page type", default="Unknown").alias("page_type"),
        f.text("page category", default="Unknown").alias("page_category"),
        dofollow(f.text("nofollow", default="FALSE")).alias("is_dofollow"),
        strict_true(f.text("is spam", default="FALSE")).alias("is_spam"),
        lenient_int(f.text("links in group", default="1"), 1).alias("links_in_group"),
        lost(f.text("lost")).alias("is_lost"),
        f.text("first seen").alias("first_seen"),
        f.json().alias("raw_json"),
        "src_file",
        "src_ord",
    )


def read_vendor_a_links(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame | None:
    """Link rows of vendor A; traffic overviews in the same folder are left to their own reader."""
    paths = [p for p in list_files(spark, folder, "*.*sv") if OVERVIEW_MARK not in p.lower()]
    return read_exports(spark, inspect(spark, paths), _vendor_a_links, multi_line)


def _keywords(rows: DataFrame, f: Fields) -> DataFrame:
    keyword = strip(f.text("keyword"))
    flag = lambda name: strict_true(f.text(name, default="FALSE"))
    return rows.filter(keyword != "").select(
        keywords_competitor(F.col("src_file")).alias("competitor_domain"),
        keyword.alias("keyword"),
        f.text("country", default="Unknown").alias("country"),
        *[flag(n).alias(f"is_{n}") for n in ("branded", "navigational", "informational", "commercial", "transactional")],
        lenient_int(f.filled("volume")).alias("volume"),
        lenient_int(f.filled("kd")).alias("kd"),
        lenient_double(f.filled("cpc")).alias("cpc"),
        lenient_double(f.filled("current organic traffic", "traffic")).alias("current_traffic"),
        lenient_int(f.filled("current position", "position"), 999).alias("current_position"),
        f.text("url").alias("url"),
        f.json().alias("raw_json"),
        "src_file",
        "src_ord",
    )


def _empty_keyword_rows(spark: SparkSession, files: list[ExportFile]) -> DataFrame:
    """Placeholder rows that keep competitors whose export is empty."""
    rows = spark.createDataFrame([(f.name,) for f in files], "src_file string")
    no, zero = F.lit(False), F.lit(0).cast("bigint")
    return rows.select(
        keywords_competitor(F.col("src_file")).alias("competitor_domain"),
        F.lit("").alias("keyword"),
        F.lit("").alias("country"),
        *[no.alias(f"is_{n}") for n in ("branded", "navigational", "informational", "commercial", "transactional")],
        zero.alias("volume"),
        zero.alias("kd"),
        F.lit(0.0).alias("cpc"),
        F.lit(0.0).alias("current_traffic"),
        F.lit(999).cast("bigint").alias("current_position"),
        F.lit("").alias("url"),
        F.lit("{}").alias("raw_json"),
        "src_file",
        F.struct(F.col("src_file").alias("file"), F.lit("").alias("path"), zero.alias("block"), zero.alias("row")).alias("src_ord"),
    )


def read_keywords(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame | None:
    """Keyword rows; a file without header still registers its competitor."""
    paths = [p for p in list_files(spark, folder, "*organic-positions*") if p.lower().endswith((".csv", ".tsv"))]
    files = inspect(spark, paths)
    rows = read_exports(spark, files, _keywords, multi_line)
    empty = [f for f in files if not f.headers]
    if not empty:
        return rows
    placeholders = _empty_keyword_rows(spark, empty)
    return placeholders if rows is None else rows.unionByName(placeholders)


def _pages(rows: DataFrame, f: Fields) -> DataFrame:
    url = f.text("url", "page url")
    return rows.filter(url != "").select(
        pages_competitor(F.col("src_file")).alias("competitor_domain"),
        url.alias("page_url"),
        path(url).alias("url_path"),
        page_class(url).alias("page_category"),
        strip(f.text("page type")).alias("page_type"),
        lenient_int(f.text("ur")).alias("ur"),
        lenient_int(f.text("current traffic", "traffic")).alias("current_traffic"),
        lenient_double(f.text("current traffic value", "traffic value")).alias("current_traffic_value"),
        lenient_int(f.text("current referring domains", "referring domains")).alias("current_ref_domains"),
        lenient_int(f.text("current # of keywords", "keywords")).alias("current_keywords"),
        strip(f.text("current top keyword", "top keyword")).alias("top_keyword"),
        lenient_int(f.text("current top keyword: volume", "volume")).alias("top_keyword_volume"),
        lenient_int(f.text("current top keyword: position", "position")).alias("top_keyword_position"),
        f.json().alias("raw_json"),
        "src_file",
        "src_ord",
    )


def export_headers(spark: SparkSession, folder: str) -> list[str]:
    """All headers of the exports in ``folder``, in order of first appearance, without those of traffic overviews."""
    paths = [p for p in list_files(spark, folder, "*.*sv") if OVERVIEW_MARK not in p.lower()]
    return all_headers(inspect(spark, paths))


def read_top_pages(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame | None:
    """Top-page rows; files without header are skipped."""
    return read_exports(spark, inspect(spark, list_files(spark, folder, "*.*sv")), _pages, multi_line)


def _vendor_b_links(rows: DataFrame, f: Fields) -> DataFrame:
    source = canonical_url(f.text("source url"))
    flag = lambda *names: loose_true(f.text(*names))
    return judged(rows, f.text("source url")).select(
        hostname(source).alias("ref_domain"),
        strip(f.text("source title")).alias("source_title"),
        source.alias("source_url"),
        canonical_url(f.text("target url")).alias("target_url"),
        f.text("target url").alias("raw_target_url"),
        strip(f.text("anchor")).alias("anchor"),
        grouped_double(f.text("page ascore", "page as")).alias("page_ascore"),
        grouped_int(f.text("external links")).alias("external_links"),
        grouped_int(f.text("internal links")).alias("internal_links"),
        *[flag(n).alias(f"is_{n}") for n in ("nofollow", "sponsored", "ugc", "text", "frame", "form", "image", "sitewide")],
        flag("new link", "newlink").alias("is_new"),
        flag("lost link", "lostlink").alias("is_lost"),
        normalise_date(f.text("first seen")).alias("first_seen"),
        normalise_date(f.text("last seen")).alias("last_seen"),
        f.json().alias("raw_json"),
        "src_file",
        "src_ord",
        f.text("source url").alias("raw_source_url"),
        "reject_reason",
        "rejected",
    )


def inspect_vendor_b(spark: SparkSession, folder: str) -> list[ExportFile]:
    paths = [p for p in list_files(spark, folder, "*.*sv") if p.lower().endswith((".csv", ".tsv"))]
    return inspect(spark, paths, latin1_fallback=True)


def has_required(file: ExportFile) -> bool:
    return len(file.headers) > 1 and not set(rules.LINK_EXPORT_REQUIRED) - set(file.lower_headers())


def read_vendor_b_links(
    spark: SparkSession, files: list[ExportFile], multi_line: bool = True, suffixes: DataFrame | None = None
) -> DataFrame | None:
    """Link rows of vendor B with the competitor of each file; rejected rows stay in, marked.

    With a table of public ``suffixes`` the referring domain is the registrable one, else the host.

    Files without the required columns are left out. The competitor of a file is decided from all of its
    rows and joined back on the file name.
    """
    rows = read_exports(spark, [f for f in files if has_required(f)], _vendor_b_links, multi_line)
    if rows is None:
        return None
    if suffixes is not None:
        rows = registrable_domains(rows, "ref_domain", suffixes, "_domain").withColumn("ref_domain", F.col("_domain")).drop("_domain")
    owners = competitor_of_files(rows.select("src_file", "src_ord", F.col("raw_target_url").alias("target_url")))
    return rows.join(owners, "src_file").drop("raw_target_url")


def skipped_files(spark: SparkSession, files: list[ExportFile], read: DataFrame | None = None) -> DataFrame:
    """Files that gave no rows and why (the part of the audit without counts); ``read`` holds the rows that were read."""
    schema = "src_file string, status string, note string"
    rows = []
    for file in files:
        missing = sorted(set(rules.LINK_EXPORT_REQUIRED) - set(file.lower_headers()))
        if not file.headers:
            rows.append((file.name, "EMPTY", "no rows"))
        elif len(file.headers) < 2:
            rows.append((file.name, "ERROR", "cannot be read as a table"))
        elif missing:
            rows.append((file.name, "SKIPPED", "missing columns: " + ", ".join(missing)))
    skipped = spark.createDataFrame(rows, schema)
    if read is None:
        return skipped
    accepted = spark.createDataFrame([(f.name, "EMPTY", "no rows") for f in files if has_required(f)], schema)
    return skipped.unionByName(accepted.join(read.select("src_file").distinct(), "src_file", "left_anti"))
