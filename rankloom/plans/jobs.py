"""Whole runs: exports in, stored facts and result tables out.

Facts are written once and every report reads the stored table, so a report scans only its own columns. With
``multi_line=False`` (no line breaks inside cells) large exports are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.numbers import rounded
from rankloom.operators import (
    action_queue,
    hierarchy,
    imports,
    keywords,
    link_facts,
    link_intel,
    link_matrix,
    link_queue,
    mailing,
    pages,
    snapshots,
)
from rankloom.session import store
from rankloom.sinks import writers
from rankloom.sources import documents, lists, overview, vendor_exports
from rankloom.sources.exports import all_headers, headers_by_file, list_files


def _stored(facts: DataFrame, path: str) -> DataFrame:
    writers.write_facts(facts, path)
    return facts.sparkSession.read.parquet(path)


def _tables(results: dict[str, DataFrame], out: str) -> None:
    for name, table in results.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")


def link_matrix_run(spark: SparkSession, exports: str, out: str, brief_keyword: str = "", multi_line: bool = True) -> None:
    """Vendor A link exports -> facts, overlap matrix, profiles, trends, briefs, traffic overview."""
    rows = vendor_exports.read_vendor_a_links(spark, exports, multi_line)
    if rows is None:
        raise ValueError(f"no link exports in {exports}")
    facts = _stored(link_facts.vendor_a_facts(rows), f"{out}/link_facts")
    matrix = link_matrix.overlap_matrix(facts)
    profile = link_matrix.competitor_profile(facts)
    _tables(
        {
            "overlap_matrix": matrix,
            "overlap_details": link_matrix.overlap_details(facts),
            "competitor_profile": profile,
            "competitor_shares": link_matrix.competitor_shares(profile),
            "yearly": link_matrix.cumulative_by_year(facts),
        },
        out,
    )
    headers = vendor_exports.export_headers(spark, exports)
    writers.write_details(detail_tables(facts, headers), f"{out}/detail_columns")
    stored = spark.read.parquet(f"{out}/overlap_matrix")
    writers.write_payload(link_matrix.content_briefs(stored, brief_keyword), f"{out}/briefs")
    wide = list_files(spark, exports, "*overview-competitors*.csv")
    if wide:
        overview.read_traffic_overviews(spark, wide).write.mode("overwrite").parquet(f"{out}/traffic")


def link_queue_run(spark: SparkSession, facts: str, out: str, brand: str) -> None:
    """Stored vendor A facts -> both execution queues."""
    links = spark.read.parquet(facts)
    _tables({"queue_v1": link_queue.queue_v1(links, brand), "queue_v2": link_queue.queue_v2(links)}, out)


def keyword_run(spark: SparkSession, exports: str, out: str, multi_line: bool = True) -> None:
    """Keyword exports -> facts, profiles, rankings, overlap matrix and queue."""
    rows = vendor_exports.read_keywords(spark, exports, multi_line)
    if rows is None:
        raise ValueError(f"no keyword exports in {exports}")
    facts = _stored(link_facts.keyword_facts(rows), f"{out}/keyword_facts")
    profile = keywords.keyword_profile(facts)
    overlap = keywords.keyword_overlap(facts)
    _tables(
        {
            "profile": profile,
            "shares": keywords.keyword_shares(profile),
            "countries": keywords.top_countries(facts),
            "landing_pages": keywords.top_landing_pages(facts),
            "terms": keywords.top_terms(facts),
            "matrix": keywords.keyword_matrix(overlap),
            "queue": keywords.keyword_queue(overlap),
        },
        out,
    )


def keyword_task_run(spark: SparkSession, facts: str, out: str, brand: str, discovered: str) -> None:
    """Stored keyword facts -> page tasks and the competing pages of their keywords."""
    rows = spark.read.parquet(facts)
    tasks = store(keywords.keyword_tasks(rows, brand, discovered))
    benchmarks = keywords.keyword_benchmarks(rows).join(tasks.select("keyword"), "keyword", "left_semi")
    _tables({"tasks": tasks, "benchmarks": keywords.ranked_benchmarks(benchmarks)}, out)


def page_run(spark: SparkSession, exports: str, out: str, multi_line: bool = True) -> None:
    """Top-page exports -> facts, profiles, page classes and rankings."""
    rows = vendor_exports.read_top_pages(spark, exports, multi_line)
    if rows is None:
        raise ValueError(f"no page exports in {exports}")
    facts = _stored(link_facts.page_facts(rows), f"{out}/page_facts")
    _tables(
        {
            "profile": pages.page_profile(facts),
            "classes": pages.class_rollup(facts),
            "top_pages": pages.top_pages(facts),
            "opportunities": pages.page_opportunities(facts),
        },
        out,
    )
    writers.write_details(page_details(facts, vendor_exports.export_headers(spark, exports)), f"{out}/detail_columns")


def site_run(spark: SparkSession, metrics: str, fetched: DataFrame, roots: DataFrame, out: str) -> None:
    """Page metrics and fetched sitemap documents -> reconciled pages, URL tree, directory summary.

    ``roots`` lists ``(site, sitemap_url)``; the domain of a site is its address without scheme.
    """
    measured = lists.read_page_metrics(spark, metrics)
    if measured is None:
        raise ValueError(f"no page metrics in {metrics}")
    listed = documents.expand_sitemaps(roots, fetched).select(
        F.regexp_replace("site", "^https?://", "").alias("domain"), F.col("page_url").alias("sitemap_url")
    )
    merged = _stored(pages.reconcile(listed, measured), f"{out}/pages")
    tree = _stored(hierarchy.url_tree(merged), f"{out}/tree")
    _tables(
        {
            "tree_listing": hierarchy.tree_listing(tree),
            "tree_shown": hierarchy.shown_nodes(tree),
            "tree_hidden": hierarchy.hidden_counts(tree),
            "health": pages.page_health(merged),
        },
        out,
    )
    writers.write_page_metrics(pages.directory_rollup(merged), pages.traffic_pages(merged), f"{out}/metrics")


def monitor_run(spark: SparkSession, crawl: DataFrame, sites: DataFrame, history: DataFrame, out: str, seen_at: str) -> None:
    """One monitoring run: changes, next snapshot, shared keyword phrases, summary.

    ``out`` must be a new folder: the snapshot that is read is never overwritten.
    """
    moment = F.lit(seen_at).cast("timestamp_ntz")
    current = store(snapshots.current_pages(crawl))
    snapshot = _stored(snapshots.applied(current, history, moment), f"{out}/snapshot")
    _tables(
        {
            "changes": snapshots.changes(current, history),
            "slug_overlap": snapshots.slug_overlap(snapshot, sites),
        },
        out,
    )
    writers.write_run_summary(snapshots.run_summary(snapshot, sites, F.lit(seen_at)), f"{out}/summary")


def link_intel_run(
    spark: SparkSession, exports: str, out: str, multi_line: bool = True, suffixes: DataFrame | None = None
) -> None:
    """Vendor B link exports -> facts, import audit, rejected rows, profiles, cohorts, domain intelligence."""
    files = vendor_exports.inspect_vendor_b(spark, exports)
    read = vendor_exports.read_vendor_b_links(spark, files, multi_line, suffixes)
    if read is None:
        raise ValueError(f"no link exports in {exports}")
    rows = store(read)
    facts = _stored(
        link_facts.vendor_b_facts(rows.filter(~F.col("rejected")).drop("rejected", "reject_reason", "raw_source_url")),
        f"{out}/link_facts",
    )
    profile = link_intel.competitor_profile(facts)
    _tables(
        {
            "audit": imports.audit(rows, facts, headers_by_file(files)),
            "rejects": imports.rejects(rows, "raw_source_url"),
            "skipped_files": vendor_exports.skipped_files(spark, files, rows),
            "profile": rounded(profile),
            "diagnostics": rounded(link_intel.diagnostics(profile)),
            "authority_bands": link_intel.authority_bands(facts),
            "link_types": link_intel.link_types(facts),
            "cohorts": link_intel.cumulative_cohorts(facts),
            "domain_intel": rounded(link_intel.domain_intel(facts)),
            "examples": link_intel.domain_examples(facts),
            "details": link_intel.link_details(facts),
        },
        out,
    )
    headers = all_headers([file for file in files if vendor_exports.has_required(file)])
    details = link_details_raw_b(spark.read.parquet(f"{out}/details"), headers)
    writers.write_details(details, f"{out}/detail_columns")
    writers.write_payload(link_intel.intel_payload(facts), f"{out}/payload")


def action_queue_run(spark: SparkSession, facts: str, enrichment: str | None, out: str, brand: str) -> None:
    """Stored vendor B facts and optional domain metrics -> action queue, open domains, counts."""
    links = lists.read_link_facts(spark, facts)
    rows = lists.read_enrichment(spark, enrichment) if enrichment else None
    if rows is None:
        rows = spark.createDataFrame(
            [], "domain string, authority_score double, monthly_visits double, organic_traffic double, "
            "organic_keywords double, source_file string",
        )
    metrics = action_queue.merge_enrichment(rows)
    queue = _stored(action_queue.action_queue(links, metrics, brand), f"{out}/queue")
    writers.write_action_queue(queue.orderBy(*action_queue.queue_order()), f"{out}/queue_csv")
    writers.write_batches(action_queue.unenriched_batches(queue), f"{out}/open_domains")
    _tables({"priority_counts": action_queue.priority_counts(queue)}, out)


def mail_run(spark: SparkSession, prospects: str, template: str, out: str) -> None:
    """Prospect list and template -> mails."""
    people = lists.read_prospects(spark, prospects)
    domain, email = lists.contact_columns(people.columns)
    subject, body = lists.read_template(spark, template)
    named = people.select(F.col(f"`{domain}`").alias("domain"), F.col(f"`{email}`").alias("email"))
    writers.write_mails(mailing.mail_merge(named, subject, body), out)


def detail_tables(facts: DataFrame, headers: list[str]) -> DataFrame:
    """Vendor A links with overlap and every original column."""
    return writers.with_raw_columns(link_matrix.overlap_details(facts), headers, ["alpha", "competitor_domain"])


def link_details_raw_b(details: DataFrame, headers: list[str]) -> DataFrame:
    """Vendor B links (``link_intel.link_details``) with their derived and every original column."""
    lead = ["competitor_domain", "ref_domain", "alpha", "state", "follow", "link_type", "authority_band"]
    return writers.with_raw_columns(details, headers, lead)


def page_details(facts: DataFrame, headers: list[str]) -> DataFrame:
    """Top pages with their class, their type as written and every original column."""
    return writers.with_raw_columns(facts, headers, ["competitor_domain", "page_url", "page_category", "page_type"])


