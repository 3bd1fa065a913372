"""Registered queries: name -> function of (spark, folder of the test tables)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import dates, flags, numbers, rules, scores, text, urls
from rankloom.functions.classify import page_class
from rankloom.functions.ladders import heat
from rankloom.functions.numbers import half_up, ratio, rounded
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
from rankloom.plans import jobs, views
from rankloom.session import store
from rankloom.sinks import writers
from rankloom.sources import documents, lists, overview, vendor_exports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEEN_AT = "2024-03-01 00:00:00"
MAIL_SUBJECT = "Partnership"
MAIL_BODY = "Hi [Name] Team,\nregards to [Name]"
BRIEF_KEYWORD = "dropshipping"
BRAND = "our product"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def links_a(spark: SparkSession, d: str) -> DataFrame:
    return link_facts.vendor_a_facts(views.links(spark, d))


def links_b(spark: SparkSession, d: str, columns: Sequence[str] | None = None) -> DataFrame:
    return link_facts.vendor_b_facts(views.links(spark, d), columns)


def keyword_facts(spark: SparkSession, d: str, columns: Sequence[str] | None = None) -> DataFrame:
    return link_facts.keyword_facts(views.keywords(spark, d), columns)


def page_facts(spark: SparkSession, d: str) -> DataFrame:
    return views.page_metrics(spark, d).withColumn("page_category", page_class(F.col("page_url")))


def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.reconcile(views.sitemap(spark, d), views.metrics_side(spark, d))


def site_tree(spark: SparkSession, d: str) -> DataFrame:
    merged = pages.reconcile(views.sitemap(spark, d), views.tree_metrics(spark, d))
    return hierarchy.url_tree(merged)


def enrichment(spark: SparkSession, d: str) -> DataFrame:
    return action_queue.merge_enrichment(views.enrichment_rows(spark, d))


#: Columns of a link that its derived columns are read from.
STATE_COLUMNS = (
    "is_lost", "is_nofollow", "is_sponsored", "is_ugc", "is_image", "is_form", "is_frame", "is_text", "page_ascore",
)
#: Columns of a link that the summary of its referring domain is read from.
SUMMARY_COLUMNS = (
    "competitor_domain", "ref_domain", "source_url", "target_url", *STATE_COLUMNS, "is_sitewide", "external_links", "first_seen",
    "last_seen",
)
#: The same with the texts that examples and evidence need.
DOMAIN_COLUMNS = (*SUMMARY_COLUMNS, "source_title", "anchor")


#: Columns of a link that its example is read from.
EXAMPLE_COLUMNS = (
    "competitor_domain", "ref_domain", "source_url", "target_url", "anchor", "is_lost", "page_ascore", "is_nofollow",
    "is_sponsored", "is_ugc", "is_sitewide",
)
#: Columns of a link that the profile of its competitor is read from.
PROFILE_COLUMNS = (
    "competitor_domain", "ref_domain", "target_url", "is_lost", "is_new", "is_nofollow", "is_sponsored", "is_ugc", "is_sitewide",
    "page_ascore",
)
COHORT_COLUMNS = ("competitor_domain", "ref_domain", "first_seen", "is_lost")


def stored_b(spark: SparkSession, d: str, columns: Sequence[str] = DOMAIN_COLUMNS) -> DataFrame:
    """Vendor B facts as a stored table, for queries that read them more than once. Only the named columns are stored."""
    return store(links_b(spark, d, columns).select(*columns))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return action_queue.scored_domains(stored_b(spark, d), enrichment(spark, d), BRAND)


def current(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.current_pages(views.crawl(spark, d))


# --- vendor A links -------------------------------------------------------------------------------------


@query
def first_wins_links(spark, d):
    return links_a(spark, d).select(
        "competitor_domain", "ref_domain", "ref_url", "target_url", "domain_rating", "src_ord.o", "src_ord.l"
    )


@query
def competitor_profile(spark, d):
    return link_matrix.competitor_profile(links_a(spark, d))


@query
def competitor_bands(spark, d):
    return link_matrix.competitor_shares(link_matrix.competitor_profile(links_a(spark, d)))


@query
def links_by_year(spark, d):
    return link_matrix.links_by_year(links_a(spark, d))


@query
def cumulative_by_year(spark, d):
    dated = links_a(spark, d).select("competitor_domain", "first_seen", "is_lost")
    return link_matrix.cumulative_by_year(store(dated))


@query
def domain_overlap(spark, d):
    return link_matrix.domain_overlap(links_a(spark, d))


@query
def overlap_matrix(spark, d):
    return link_matrix.overlap_matrix(links_a(spark, d))


@query
def overlap_matrix_topk(spark, d):
    return link_matrix.top_overlap(link_matrix.overlap_matrix(links_a(spark, d)), 100).select(
        "ref_domain", "alpha", "total_links", "max_dr", "max_traffic", "is_spam", "is_dofollow"
    )


@query
def overlap_details(spark, d):
    return link_matrix.overlap_details(store(links_a(spark, d))).select(
        "alpha", "competitor_domain", "ref_domain", "ref_url", "target_url"
    )


@query
def content_briefs(spark, d):
    return link_matrix.content_briefs(link_matrix.overlap_matrix(links_a(spark, d)), BRIEF_KEYWORD)


def _stats_v1(spark, d):
    return link_queue.domain_stats(links_a(spark, d), rules.URL_TYPES_V1, rules.NO_ANCHOR_V1)


def _stats_v2(spark, d):
    return link_queue.domain_stats(links_a(spark, d), rules.URL_TYPES_V2, rules.NO_ANCHOR)


@query
def link_type_v1(spark, d):
    return link_queue.link_types_v1(_stats_v1(spark, d)).select("ref_domain", "link_type")


@query
def link_type_v2(spark, d):
    return link_queue.link_types_v2(_stats_v2(spark, d)).select(
        "ref_domain", "link_type", "confidence_pct", "anchor_intent"
    )


@query
def queue_score_v1(spark, d):
    return link_queue.score_v1(_stats_v1(spark, d)).select(
        "ref_domain", "alpha", "max_dr", "max_traffic", "any_dofollow", "any_spam", "auto_score", "priority"
    )


@query
def queue_score_v2(spark, d):
    return link_queue.score_v2(_stats_v2(spark, d)).select(
        "ref_domain", "alpha", "max_dr", "max_traffic", "any_dofollow", "any_spam", "auto_score"
    )


@query
def tier_v2(spark, d):
    stats = link_queue.link_types_v2(_stats_v2(spark, d))
    return link_queue.tiers_v2(link_queue.score_v2(stats)).select(
        "ref_domain", "tier", "tier_rank", "tier_label", "type_label", "action"
    )


@query
def queue_v1(spark, d):
    return link_queue.queue_v1(links_a(spark, d), BRAND)


@query
def queue_v2(spark, d):
    return link_queue.queue_v2(links_a(spark, d))


@query
def final_score_blend(spark, d):
    """Blends of the machine score with manual scores, where a manual score exists."""
    c = F.col
    stats = link_queue.score_v1(_stats_v1(spark, d))
    manual = F.when(c("max_dr") >= 30, (c("max_dr") % 50).cast("double"))
    hard = F.when(c("alpha") >= 3, c("alpha").cast("double") * 10)
    return stats.select(
        "ref_domain",
        scores.blend_two(c("auto_score"), manual).alias("blend_two"),
        scores.blend_three(c("auto_score"), manual, hard).alias("blend_three"),
        scores.blend_or_machine(c("auto_score"), manual).alias("blend_or_machine"),
    )


# --- keywords -------------------------------------------------------------------------------------------

#: Columns of a ranking that the tables of the keywords are read from.
INTENT_COLUMNS = ("is_informational", "is_commercial", "is_transactional")
OVERLAP_COLUMNS = ("is_branded", "current_traffic", "volume", "kd", "cpc", *INTENT_COLUMNS)
TASK_COLUMNS = (*OVERLAP_COLUMNS, "is_navigational")
BENCHMARK_COLUMNS = ("is_branded", "current_traffic", "url")
TERM_COLUMNS = ("is_branded", "current_traffic", "current_position", "volume", "kd", "cpc", "url")
KEYWORD_PROFILE_COLUMNS = (*TASK_COLUMNS, "current_position")


@query
def keyword_profile(spark, d):
    return keywords.keyword_profile(keyword_facts(spark, d, KEYWORD_PROFILE_COLUMNS))


@query
def keyword_shares(spark, d):
    return keywords.keyword_shares(keywords.keyword_profile(keyword_facts(spark, d, KEYWORD_PROFILE_COLUMNS)))


@query
def keyword_country_top5(spark, d):
    columns = ("competitor_domain", "country", "current_traffic")
    return keywords.top_countries(store(keyword_facts(spark, d, columns).select(*columns)), 5)


@query
def keyword_page_top10(spark, d):
    columns = ("competitor_domain", "url", "keyword", "current_traffic")
    return keywords.top_landing_pages(store(keyword_facts(spark, d, columns).select(*columns)), 10)


@query
def keyword_terms_top10(spark, d):
    return rounded(keywords.top_terms(keyword_facts(spark, d, TERM_COLUMNS), 10))


@query
def keyword_overlap(spark, d):
    return rounded(keywords.keyword_overlap(keyword_facts(spark, d, OVERLAP_COLUMNS)))


@query
def keyword_matrix(spark, d):
    return rounded(keywords.keyword_matrix(keywords.keyword_overlap(keyword_facts(spark, d, OVERLAP_COLUMNS))))


@query
def keyword_score(spark, d):
    return rounded(
        keywords.keyword_scores(keywords.keyword_overlap(keyword_facts(spark, d, OVERLAP_COLUMNS))).select(
            "keyword", "alpha", "volume", "kd", "cpc", "traffic", "auto_score", "priority", "action"
        )
    )


@query
def keyword_queue(spark, d):
    return rounded(keywords.keyword_queue(keywords.keyword_overlap(keyword_facts(spark, d, OVERLAP_COLUMNS))))


@query
def keyword_tasks(spark, d):
    return rounded(keywords.keyword_tasks(keyword_facts(spark, d, TASK_COLUMNS), BRAND, "2024-03-01"))


@query
def keyword_benchmarks(spark, d):
    return keywords.ranked_benchmarks(keywords.keyword_benchmarks(keyword_facts(spark, d, BENCHMARK_COLUMNS)))


@query
def keyword_brand_free(spark, d):
    """Keywords that do not hold the name of a competitor, blanks ignored."""
    names = F.array(*[F.lit(n) for n in views.COMPETITOR_NAMES])
    rows = views.keywords(spark, d).select(
        "keyword", F.element_at(names, (F.col("kd") % len(views.COMPETITOR_NAMES) + 1).cast("int")).alias("competitor_domain")
    )
    kept = keywords.brand_free(rows)
    return kept.groupBy("competitor_domain").agg(F.count(F.lit(1)).alias("n_kept"), F.min("keyword").alias("first_keyword"))


# --- pages ----------------------------------------------------------------------------------------------


@query
def page_profile(spark, d):
    return pages.page_profile(page_facts(spark, d))


@query
def page_category_rollup(spark, d):
    return pages.class_rollup(page_facts(spark, d))


@query
def page_top10(spark, d):
    return pages.top_pages(page_facts(spark, d), 10)


@query
def page_opportunities(spark, d):
    return pages.page_opportunities(page_facts(spark, d))


@query
def sitemap_metrics_outer(spark, d):
    return merged_pages(spark, d)


@query
def orphan_zombie_pages(spark, d):
    return (
        pages.page_health(merged_pages(spark, d))
        .filter(F.col("is_orphan") | F.col("is_zombie"))
        .select("domain", "canonical_key", "final_url", "is_orphan", "is_zombie")
    )


@query
def dir_l1_rollup(spark, d):
    return pages.directory_rollup(merged_pages(spark, d))


@query
def traffic_pages(spark, d):
    return pages.traffic_pages(store(merged_pages(spark, d))).select("domain", "final_url", "traffic", "keywords", "in_sitemap")


@query
def url_tree_rollup(spark, d):
    return site_tree(spark, d).select(
        "node_id", "parent_id", "label", "depth", "traffic", "n_pages", "keywords", "best_keyword", "page_url", "heat", "is_orphan"
    )


@query
def url_tree_listing(spark, d):
    return hierarchy.tree_listing(site_tree(spark, d))


@query
def url_tree_zombie_cap(spark, d):
    return hierarchy.shown_nodes(store(site_tree(spark, d)), 5).select("node_id", "parent_id", "depth", "traffic", "n_pages")


@query
def url_tree_hidden(spark, d):
    return hierarchy.hidden_counts(site_tree(spark, d), 5)


# --- snapshots and slugs --------------------------------------------------------------------------------


@query
def snapshot_added(spark, d):
    return snapshots.added(current(spark, d), views.history(spark, d))


@query
def snapshot_removed(spark, d):
    return snapshots.removed(current(spark, d), views.history(spark, d))


@query
def snapshot_changes(spark, d):
    return snapshots.changes(current(spark, d), views.history(spark, d))


@query
def snapshot_apply(spark, d):
    seen = F.lit(SEEN_AT).cast("timestamp_ntz")
    return snapshots.applied(current(spark, d), views.history(spark, d), seen)


@query
def slug_keywords(spark, d):
    return (
        snapshots.slug_keywords(views.slug_pages(spark, d), views.slug_sites(spark, d))
        .groupBy("keyword", "domain")
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


@query
def slug_overlap(spark, d):
    return snapshots.slug_overlap(views.slug_pages(spark, d), views.slug_sites(spark, d))


@query
def monitor_summary(spark, d):
    seen = F.lit(SEEN_AT)
    return snapshots.run_summary(views.slug_pages(spark, d), views.slug_sites(spark, d), seen)


# --- URLs and scalar functions over the tables ----------------------------------------------------------


@query
def canonical_url(spark, d):
    url = F.col("url")
    return views.table(spark, d, "pages").select(
        "page_id",
        urls.canonical_url(url).alias("canonical"),
        urls.canonical_url(F.upper(F.concat(F.lit(" "), url))).alias("from_upper"),
        urls.canonical_url(F.regexp_replace(url, "^https?://([^/]*)", "http://me:pw@$1:8080")).alias("with_port"),
        urls.canonical_url(F.regexp_replace(url, "^https?://", "")).alias("no_scheme"),
    )


@query
def canonical_key(spark, d):
    url = F.col("url")
    return views.table(spark, d, "pages").select(
        "page_id",
        urls.canonical_key(url).alias("key"),
        urls.canonical_key(F.upper(url)).alias("key_from_upper"),
        urls.canonical_key(F.replace(url, F.lit("/en/"), F.lit("/e%6e+x/"))).alias("key_decoded"),
    )


@query
def url_forms(spark, d):
    url = F.col("url")
    messy = F.regexp_replace(url, "([a-z])/", "$1//")
    return views.table(spark, d, "pages").select(
        "page_id",
        urls.site_host(url).alias("site_host"),
        urls.hostname(url).alias("hostname"),
        urls.page_url(url).alias("page_url"),
        urls.page_url(messy).alias("page_url_messy"),
        urls.sitemap_url(urls.hostname(url)).alias("sitemap_url"),
        urls.first_directory(url).alias("directory"),
    )


@query
def registrable_domain(spark, d):
    hosts = views.table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"))
    suffixes = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("suffix")).distinct()
    return link_facts.registrable_domains(hosts, "host", suffixes)


@query
def registrable_rules(spark, d):
    """Rules with wildcards and exceptions, made from the hosts: the last label is a suffix, those of even pages also any label
    before it, and some endings of two labels are exceptions."""
    hosts = views.table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"))
    last = F.regexp_extract("host", r"([^.]+)$", 1)
    two = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    wild = hosts.filter("page_id % 2 = 0").select(F.concat(F.lit("*."), last).alias("suffix"))
    except_ = hosts.filter("page_id % 5 = 0").select(F.concat(F.lit("!"), two).alias("suffix"))
    rules_ = hosts.select(last.alias("suffix")).union(wild).union(except_).distinct()
    return link_facts.registrable_domains(hosts, "host", rules_)


@query
def link_fingerprint_dedupe(spark, d):
    facts = links_b(spark, d, ("competitor_domain", "source_url", "anchor"))
    return facts.select("competitor_domain", "link_fingerprint", "source_url", "anchor", "src_ord.o", "src_ord.l")


@query
def lenient_numbers(spark, d):
    """Number readings of every word of every document."""
    c = F.col
    words = views.tokens(spark, d).select(
        "source",
        numbers.lenient_int(c("word")).alias("as_int"),
        numbers.lenient_double(c("word")).alias("as_double"),
        numbers.grouped_int(c("word")).alias("as_grouped"),
        numbers.metric_double(c("word")).alias("as_metric"),
        flags.loose_true(c("word")).alias("flag"),
        flags.strict_true(c("word")).alias("strict"),
    )
    whole_sum = lambda name: F.sum(c(name).cast("decimal(28,0)")).cast("string")
    return words.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_words"),
        whole_sum("as_int").alias("sum_int"),
        numbers.exact_sum(c("as_double"), 0).cast("string").alias("sum_double"),
        numbers.unsummed(c("as_double"), 0).alias("n_unsummed"),
        whole_sum("as_grouped").alias("sum_grouped"),
        F.count("as_metric").alias("n_metric"),
        F.count_if(c("flag")).alias("n_flag"),
        F.count_if(c("strict")).alias("n_strict"),
    )


@query
def normalised_dates(spark, d):
    """Ship dates written in the export layouts and read back."""
    c = F.col
    layouts = ("yyyy-MM-dd", "yyyy/M/d", "dd/MM/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy")
    written = F.element_at(
        F.array(*[F.date_format("l_shipdate", f) for f in layouts], F.concat(F.lit("week "), F.date_format("l_shipdate", "yyyy"))),
        c("l_linenumber"),
    )
    read = views.table(spark, d, "lineitem").select(written.alias("written")).withColumn(
        "normal", dates.normalise_date(c("written"))
    )
    return read.groupBy("written", "normal", dates.year_of(c("normal")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query
def word_forms(spark, d):
    """Slug, title and company forms of the keywords."""
    c = F.col
    rows = views.keywords(spark, d).select("keyword").distinct()
    return rows.select(
        "keyword",
        text.slug(c("keyword")).alias("slug"),
        text.title_case(c("keyword")).alias("title"),
        text.capitalised(c("keyword")).alias("capitalised"),
        text.company_name(F.concat(F.lit("www."), F.replace("keyword", F.lit(" "), F.lit(".")))).alias("company"),
    )


@query
def heat_tiers(spark, d):
    traffic = F.col("current_traffic").cast("double")
    return views.page_metrics(spark, d).groupBy(heat(traffic).alias("heat")).agg(F.count(F.lit(1)).alias("n_pages"))


# --- vendor B links -------------------------------------------------------------------------------------


@query
def link_profile_b(spark, d):
    return rounded(link_intel.competitor_profile(links_b(spark, d, PROFILE_COLUMNS)))


@query
def authority_bands_b(spark, d):
    return link_intel.authority_bands(links_b(spark, d, ("competitor_domain", "page_ascore", "is_lost")))


@query
def link_types_b(spark, d):
    return link_intel.link_types(links_b(spark, d, ("competitor_domain", "is_lost")))


@query
def cohorts_b(spark, d):
    return link_intel.cohorts(links_b(spark, d, COHORT_COLUMNS))


@query
def cumulative_cohorts_b(spark, d):
    return link_intel.cumulative_cohorts(stored_b(spark, d, COHORT_COLUMNS))


@query
def domain_intel_b(spark, d):
    return rounded(link_intel.domain_intel(stored_b(spark, d, SUMMARY_COLUMNS)))


@query
def domain_examples_topn(spark, d):
    return link_intel.domain_examples(stored_b(spark, d, EXAMPLE_COLUMNS), 20)


@query
def intel_payload(spark, d):
    payload = link_intel.intel_payload(stored_b(spark, d, (*SUMMARY_COLUMNS, "anchor")))
    return payload.withColumns(
        {"competitors": F.array_join("competitors", ", "), "examples": F.array_join("examples", "\n")}
    )


@query
def link_details_b(spark, d):
    facts = stored_b(spark, d, ("competitor_domain", "ref_domain", "source_url", "target_url", "anchor", *STATE_COLUMNS))
    facts = facts.withColumn("digest", F.unhex(link_facts.fingerprint()))
    return link_intel.link_details(facts).select(
        "competitor_domain", "ref_domain", "source_url", "alpha", "state", "follow", "link_type", "authority_band",
        F.lower(F.hex("digest")).alias("link_fingerprint"),
    )


@query
def link_details_raw_b(spark, d):
    """Vendor B links with derived columns and the original ones read back from the raw row."""
    facts = stored_b(spark, d, ("competitor_domain", "ref_domain", "raw_json", *STATE_COLUMNS))
    return jobs.link_details_raw_b(link_intel.link_details(facts), ["Link anchor", "Anchor", "Missing"])


@query
def ordered_facts_b(spark, d):
    return link_intel.ordered_facts(links_b(spark, d, ("competitor_domain", "ref_domain", "source_url", "first_seen", "is_lost"))).select(
        "competitor_domain", "ref_domain", "source_url", "link_fingerprint", "first_seen", "is_lost"
    )


@query
def link_detail_columns(spark, d):
    """Links with their original columns read back from the raw row."""
    return writers.with_raw_columns(
        links_a(spark, d), ["Link anchor", "Anchor", "Missing"], ["competitor_domain", "ref_domain", "ref_url"]
    )


@query
def diagnostic_levels(spark, d):
    return rounded(link_intel.diagnostics(link_intel.competitor_profile(links_b(spark, d, PROFILE_COLUMNS))))


@query
def enrichment_merge(spark, d):
    return enrichment(spark, d).withColumn("source_files", F.array_join("source_files", ", "))


@query
def drop_detection(spark, d):
    return action_queue.drop_detection(stored_b(spark, d))


@query
def action_path(spark, d):
    return action_queue.action_path(stored_b(spark, d), BRAND)


@query
def action_queue_summary(spark, d):
    measures = link_intel.domain_measures(stored_b(spark, d, SUMMARY_COLUMNS)).select(
        "domain", "alpha", "per_competitor", "backlinks", "live_backlinks", "live_rate", "high_page_as_rate"
    )
    return rounded(action_queue.with_enrichment(measures, enrichment(spark, d)))


@query
def action_queue_score(spark, d):
    return scored(spark, d).select("domain", "priority", "raw_score", "machine_score", "score_breakdown")


@query
def action_queue_full(spark, d):
    return action_queue.action_queue(stored_b(spark, d), enrichment(spark, d), BRAND)


@query
def unenriched_batches(spark, d):
    return action_queue.unenriched_batches(scored(spark, d))


@query
def priority_counts(spark, d):
    return action_queue.priority_counts(scored(spark, d))


# --- imports and documents ------------------------------------------------------------------------------


@query
def modal_target(spark, d):
    hosts = views.links(spark, d).select("src_file", "src_ord", urls.hostname(F.col("target_url")).alias("host"))
    return rounded(imports.modal_value(hosts, "src_file", "host"))


@query
def import_competitors(spark, d):
    return imports.competitor_of_files(views.links(spark, d))


@query
def file_competitors(spark, d):
    """Competitor and domain readings of export file names made from the parts."""
    c = F.col
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit("."))
    part = views.table(spark, d, "part").select("p_partkey", name.alias("name"))
    made = lambda tail: F.concat(c("name"), F.lit(tail))
    return part.select(
        "p_partkey",
        vendor_exports.links_competitor(made("-backlinks-2024.csv")).alias("links_named"),
        vendor_exports.links_competitor(made("_all.csv")).alias("links_plain"),
        vendor_exports.keywords_competitor(made("-organic-positions-us.csv")).alias("keywords_named"),
        vendor_exports.pages_competitor(made("_top_pages.tsv")).alias("pages_named"),
        vendor_exports.pages_competitor(made(".csv")).alias("pages_plain"),
        lists.file_domain(F.concat(F.lit("www."), made("-subdomains-x.csv"))).alias("domain_named"),
        lists.file_domain(made(".csv")).alias("domain_plain"),
        imports.cleaned_file_name(F.concat(F.lit("backlinks_"), made("-export.csv"))).alias("cleaned"),
    )


@query
def import_audit(spark, d):
    rows = imports.judged(views.written_links(spark, d), F.col("written_source"))
    kept = link_facts.vendor_b_facts(rows.filter(~F.col("rejected")), ("src_file",))
    return imports.audit(rows, kept, {"backlinks-A.csv": ["Anchor", "UGC", "First seen"]})


@query
def import_rejects(spark, d):
    """Rejected rows of every file by reason and by what was written."""
    rows = imports.judged(views.written_links(spark, d), F.col("written_source"))
    return imports.rejects(rows, "written_source")


@query
def traffic_unpivot(spark, d):
    wide = views.overview_rows(spark, d)
    return overview.long_traffic(wide, "date", {k: k for k in wide.columns if k != "date"})


@query
def href_extract(spark, d):
    return (
        documents.page_links(views.table(spark, d, "pages"))
        .groupBy("page_url", "href")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def sitemap_locations(spark, d):
    return documents.sitemap_locations(views.sitemap_documents(spark, d))


@query
def robots_sitemaps(spark, d):
    return documents.robots_sitemaps(views.robots(spark, d)).groupBy("site", "sitemap_url").agg(F.count(F.lit(1)).alias("n"))


@query
def sitemap_expand(spark, d):
    roots = views.robots(spark, d).select("site", F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"))
    return documents.expand_sitemaps(roots, views.sitemap_documents(spark, d))


@query
def sitemap_frontier(spark, d):
    """What a walk that stops at the roots leaves open."""
    roots = views.robots(spark, d).select("site", F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"))
    return documents.walk_sitemaps(roots, views.sitemap_documents(spark, d), 0).frontier


@query
def mail_merge(spark, d):
    return mailing.mail_merge(views.prospects(spark, d), MAIL_SUBJECT, MAIL_BODY)


@query
def anchor_readings(spark, d):
    """Anchors read from the raw rows, with the marks for none and for an unreadable row."""
    anchor = link_queue.queue_anchor(rules.NO_ANCHOR)
    return (
        views.links(spark, d)
        .groupBy("competitor_domain", anchor.alias("anchor_text"))
        .agg(F.count(F.lit(1)).alias("n"), half_up(ratio(F.sum("links_in_group"), F.count(F.lit(1))), 6).alias("mean_links"))
    )
