"""Vendor B link facts (one row per link): competitor profiles, cohorts and domain intelligence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.classify import asset_path, mask_parts, pattern_masks, technical_path
from rankloom.functions.dates import year_of
from rankloom.functions.flags import follows
from rankloom.functions.ladders import AUTHORITY_BANDS, LINK_KINDS, authority_band, level, link_kind
from rankloom.functions.numbers import exact, half_up, ratio, whole_even
from rankloom.functions.text import joined
from rankloom.functions.urls import path
from rankloom.operators.ranking import running_totals, set_apart, top_per_group, yearly_grid

EVIDENCE_WORDS: Mapping[str, Sequence[str]] = {
    "self_serve": rules.SELF_SERVE,
    "directory": rules.DIRECTORY_PATHS,
    "official": rules.OFFICIAL_ENTRY,
    "strategic": rules.STRATEGIC,
    "editorial": rules.EDITORIAL,
}
TYPE_COLUMNS = {kind: f"n_{kind.lower()}" for kind in LINK_KINDS}
BAND_COLUMNS = {label: f"as_{label.replace('-', '_')}" for label, _, _ in AUTHORITY_BANDS}


def link_follows() -> Column:
    return follows(F.col("is_nofollow"), F.col("is_sponsored"), F.col("is_ugc"))


def link_type() -> Column:
    return link_kind(F.col("is_image"), F.col("is_form"), F.col("is_frame"), F.col("is_text"))


def _count(test: Column) -> Column:
    return F.count_if(test).cast("bigint")


def _authority_sum(test: Column) -> Column:
    return F.sum(F.when(test, exact(F.col("page_ascore"))).otherwise(F.lit(0).cast("decimal(24,6)")))


def competitor_profile(links: DataFrame) -> DataFrame:
    """Historic and live figures of every competitor, from one pass over the links.

    The distinct counts are folded on (competitor, value) before they meet on the competitor, so a
    competitor with a large part of the links is not counted in one task.
    """
    c = F.col
    live = ~c("is_lost")
    sums = links.groupBy("competitor_domain").agg(
        F.count_distinct("ref_domain").alias("total_domains"),
        F.count_distinct(F.when(live, c("ref_domain"))).alias("live_domains"),
        F.count_distinct(F.nullif("target_url", F.lit(""))).alias("targets"),
        F.count(F.lit(1)).alias("links"),
        _count(live).alias("live"),
        _count(c("is_new")).alias("new"),
        _count(live & link_follows()).alias("follow"),
        _count(live & c("is_nofollow")).alias("nofollow"),
        _count(live & c("is_sitewide")).alias("sitewide"),
        _count(live & c("is_sponsored")).alias("sponsored"),
        _count(live & c("is_ugc")).alias("ugc"),
        _count(live & (c("page_ascore") >= rules.HIGH_PAGE_AUTHORITY)).alias("high"),
        _authority_sum(live).alias("authority"),
    )
    rate = lambda part: ratio(c(part), c("live"))
    return sums.select(
        "competitor_domain",
        "total_domains",
        c("links").alias("total_backlinks"),
        "live_domains",
        (c("total_domains") - c("live_domains")).alias("lost_domains"),
        c("live").alias("live_backlinks"),
        (c("links") - c("live")).alias("lost_backlinks"),
        c("new").alias("new_flagged_backlinks"),
        c("targets").alias("unique_target_pages"),
        rate("follow").alias("follow_rate_live"),
        rate("nofollow").alias("nofollow_rate_live"),
        rate("sitewide").alias("sitewide_rate_live"),
        rate("sponsored").alias("sponsored_rate_live"),
        rate("ugc").alias("ugc_rate_live"),
        rate("high").alias("high_as_rate_live"),
        rate("authority").alias("avg_page_as_live"),
        ratio(c("links"), c("total_domains")).alias("link_concentration"),
        ratio(c("live"), c("live_domains")).alias("live_link_concentration"),
    )


def authority_bands(links: DataFrame) -> DataFrame:
    """Links per page-authority band and competitor, all and live, and the live share."""
    band = authority_band(F.col("page_ascore"))
    live = ~F.col("is_lost")
    counted = links.groupBy("competitor_domain").agg(
        *[_count(band == label).alias(name) for label, name in BAND_COLUMNS.items()],
        *[_count(live & (band == label)).alias(f"live_{name}") for label, name in BAND_COLUMNS.items()],
        _count(live).alias("_live"),
    )
    return counted.withColumns(
        {
            f"live_{name}_share": half_up(ratio(F.col(f"live_{name}"), F.greatest("_live", F.lit(1))), 6)
            for name in BAND_COLUMNS.values()
        }
    ).drop("_live")


def link_types(links: DataFrame) -> DataFrame:
    """Links per placement type and competitor, all and live."""
    kind, live = link_type(), ~F.col("is_lost")
    return links.groupBy("competitor_domain").agg(
        *[_count(kind == label).alias(name) for label, name in TYPE_COLUMNS.items()],
        *[_count(live & (kind == label)).alias(f"live_{name}") for label, name in TYPE_COLUMNS.items()],
    )


COHORTS = ("backlinks", "live_backlinks", "domains", "live_domains")


def cohorts(links: DataFrame) -> DataFrame:
    """Links by the year they were first seen, domains by the year of their earliest link.

    One pass: links are folded per competitor, domain and year; a domain then holds one small entry per
    year plus the entry of the domain itself.
    """
    c = F.col
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    seen = F.nullif("first_seen", F.lit(""))
    per_year = links.groupBy("competitor_domain", "ref_domain", year_of(seen).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), _count(~c("is_lost")).alias("n_live"), F.min(seen).alias("seen")
    )
    by_link = F.struct(
        "year", c("n").alias(COHORTS[0]), c("n_live").alias(COHORTS[1]), zero.alias(COHORTS[2]), zero.alias(COHORTS[3])
    )
    by_domain = F.struct(
        year_of(c("first")).alias("year"),
        zero.alias(COHORTS[0]),
        zero.alias(COHORTS[1]),
        one.alias(COHORTS[2]),
        (c("live") > 0).cast("bigint").alias(COHORTS[3]),
    )
    per_domain = per_year.groupBy("competitor_domain", "ref_domain").agg(
        F.collect_list(by_link).alias("years"), F.min("seen").alias("first"), F.sum("n_live").alias("live")
    )
    return (
        per_domain.select("competitor_domain", F.inline(F.concat("years", F.array(by_domain))))
        .filter(c("year").isNotNull())
        .groupBy("competitor_domain", "year")
        .agg(*[F.sum(m).alias(m) for m in COHORTS])
    )


def cumulative_cohorts(links: DataFrame) -> DataFrame:
    grid = yearly_grid(cohorts(links), "competitor_domain", "year", COHORTS)
    return running_totals(grid, "competitor_domain", "year", COHORTS)


def mask_columns(name: str) -> list[str]:
    """The columns that hold the masks of a word list."""
    return [f"mask_{name}" if i == 0 else f"mask_{name}_{i}" for i in range(len(mask_parts(EVIDENCE_WORDS[name])))]


def row_evidence(links: DataFrame) -> DataFrame:
    """Signals of the acquisition path that a link's texts hold, as flags and pattern masks.

    Text and path are columns of their own because each is read by several signals.
    """
    c = F.col
    text = F.lower(F.concat_ws("\n", "source_title", "source_url", "anchor"))
    return links.withColumns({"_text": text, "_path": F.lower(path(c("source_url")))}).withColumns(
        {
            **{column: mask for name, words in EVIDENCE_WORDS.items() for column, mask in zip(mask_columns(name), pattern_masks(c("_text"), words))},
            "asset": asset_path(c("_path")),
            "technical": technical_path(c("_path")),
        }
    )


def referring_domain() -> Column:
    return F.lower(F.trim("ref_domain"))


def domain_evidence(links: DataFrame) -> DataFrame:
    """Pattern masks, static files and technical pages per referring domain.

    Equal texts of a domain are folded first, so some two hundred patterns are sought once in each different text and not in
    every link; the folded rows meet on all their texts, which spreads a domain with very many links.
    """
    texts = ["source_title", "source_url", "anchor"]
    folded = (
        links.select(referring_domain().alias("domain"), *texts)
        .filter(F.col("domain") != "")
        .groupBy("domain", *texts)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    none = F.lit(0).cast("bigint")
    return row_evidence(folded).groupBy("domain").agg(
        F.sum(F.when(F.col("asset"), F.col("n")).otherwise(none)).alias("assets"),
        F.sum(F.when(F.col("technical"), F.col("n")).otherwise(none)).alias("technicals"),
        *[F.bit_or(m).alias(m) for name in EVIDENCE_WORDS for m in mask_columns(name)],
    )


def domain_rollup(links: DataFrame) -> DataFrame:
    """Additive measures per referring domain; every ratio below is read from this one table.

    Links are folded per domain and competitor and then per domain, all with constant-size states, so a
    domain holding a large part of the links never gathers them. Measures a query does not use are pruned.
    """
    c = F.col
    live = ~c("is_lost")
    kind = link_type()
    additive = {
        "backlinks": F.count(F.lit(1)),
        "live_backlinks": _count(live),
        "follow": _count(link_follows()),
        "live_follow": _count(live & link_follows()),
        "sitewide": _count(c("is_sitewide")),
        "sponsored": _count(c("is_sponsored")),
        "ugc": _count(c("is_ugc")),
        "live_high": _count(live & (c("page_ascore") >= rules.HIGH_PAGE_AUTHORITY)),
        "external": F.sum("external_links"),
        "authority": _authority_sum(F.lit(True)),
        "live_authority": _authority_sum(live),
        "own": _count(F.lower("ref_domain") == F.lower("competitor_domain")),
        **{name: _count(kind == label) for label, name in TYPE_COLUMNS.items()},
    }
    per_pair = (
        links.withColumn("domain", referring_domain())
        .filter(c("domain") != "")
        .groupBy("domain", "competitor_domain")
        .agg(
            *[value.alias(name) for name, value in additive.items()],
            F.max("page_ascore").alias("max_page_as"),
        )
    )
    return per_pair.groupBy("domain").agg(
        F.count(F.lit(1)).alias("alpha"),
        *[F.sum(name).alias(name) for name in additive],
        F.max("max_page_as").alias("max_page_as"),
        joined(F.collect_list("competitor_domain"), ", ").alias("competitors"),
        joined(F.collect_list(F.format_string("%s:%d", c("competitor_domain"), c("backlinks"))), ", ").alias(
            "per_competitor"
        ),
    )


def domain_reach(links: DataFrame) -> DataFrame:
    """Distinct source and target pages and the span of dates of every referring domain."""
    c = F.col
    filled = lambda name: F.nullif(name, F.lit(""))
    narrow = links.select(
        F.lower(F.trim("ref_domain")).alias("domain"),
        filled("source_url").alias("source_url"),
        filled("target_url").alias("target_url"),
        filled("first_seen").alias("first_seen"),
        filled("last_seen").alias("last_seen"),
    ).filter(c("domain") != "")
    return narrow.groupBy("domain").agg(
        F.count_distinct("source_url").alias("source_pages"),
        F.count_distinct("target_url").alias("target_pages"),
        F.coalesce(F.min("first_seen"), F.lit("")).alias("earliest_first_seen"),
        F.coalesce(F.max("last_seen"), F.lit("")).alias("latest_last_seen"),
    )


def type_mix() -> Column:
    """Placement types of a domain with their counts, most frequent first."""
    pairs = F.filter(
        F.array(
            *[
                F.struct((-F.col(name)).alias("minus_n"), F.lit(i).alias("place"), F.lit(kind).alias("kind"))
                for i, (kind, name) in enumerate(TYPE_COLUMNS.items())
            ]
        ),
        lambda p: p["minus_n"] < 0,
    )
    return F.array_join(
        F.transform(F.array_sort(pairs), lambda p: F.format_string("%s:%d", p["kind"], -p["minus_n"])), ", "
    )


def domain_measures(links: DataFrame) -> DataFrame:
    """Summary of every referring domain: counts, rates, means, dates and placement mix."""
    c = F.col
    rate = lambda part, whole="backlinks": ratio(c(part), c(whole))
    return domain_rollup(links).join(domain_reach(links), "domain").select(
        "domain",
        "alpha",
        "competitors",
        "per_competitor",
        "backlinks",
        "live_backlinks",
        "source_pages",
        "target_pages",
        "max_page_as",
        rate("live_backlinks").alias("live_rate"),
        rate("authority").alias("avg_page_as"),
        rate("live_authority", "live_backlinks").alias("live_avg_page_as"),
        rate("live_high", "live_backlinks").alias("high_page_as_rate"),
        rate("follow").alias("follow_rate"),
        rate("live_follow", "live_backlinks").alias("live_follow_rate"),
        rate("sitewide").alias("sitewide_rate"),
        rate("sponsored").alias("sponsored_rate"),
        rate("ugc").alias("ugc_rate"),
        rate("external").alias("avg_external_links"),
        "earliest_first_seen",
        "latest_last_seen",
        type_mix().alias("type_mix"),
        "own",
    )


INTEL_COLUMNS = (
    "domain", "alpha", "competitors", "backlinks", "live_backlinks", "source_pages", "target_pages",
    "max_page_as", "avg_page_as", "live_avg_page_as", "follow_rate", "live_follow_rate", "sitewide_rate",
    "sponsored_rate", "ugc_rate", "avg_external_links", "earliest_first_seen", "latest_last_seen", "type_mix",
)


def domain_intel(links: DataFrame, threshold: int = 1) -> DataFrame:
    """Referring domains ranked by overlap, live links, authority and clean structure."""
    return (
        domain_measures(links)
        .select(*INTEL_COLUMNS)
        .filter(F.col("alpha") >= threshold)
        .orderBy(
            F.desc("alpha"),
            F.desc("live_backlinks"),
            F.desc("max_page_as"),
            F.desc("live_follow_rate"),
            F.asc("sitewide_rate"),
            F.asc("domain"),
        )
    )


def link_example(authority_label: str = "AS") -> Column:
    """One link as a line of text: competitor, state, authority, URLs, anchor and attributes."""
    c = F.col
    marks = F.concat_ws(
        "/",
        F.when(link_follows(), "Follow"),
        F.when(c("is_nofollow"), "Nofollow"),
        F.when(c("is_sponsored"), "Sponsored"),
        F.when(c("is_ugc"), "UGC"),
        F.when(c("is_sitewide"), "Sitewide"),
    )
    known = lambda value: F.coalesce(value, F.lit("null"))
    return F.concat(
        F.lit("["),
        known(c("competitor_domain")),
        F.when(c("is_lost"), f"] [LOST] {authority_label} ").otherwise(f"] [LIVE] {authority_label} "),
        known(whole_even(c("page_ascore"))),
        F.lit(" | "),
        known(c("source_url")),
        F.lit(" --["),
        F.coalesce(F.nullif("anchor", F.lit("")), F.lit(rules.NO_ANCHOR)),
        F.lit("]--> "),
        known(c("target_url")),
        F.lit(" ("),
        F.when(marks == "", "No special attribute").otherwise(marks),
        F.lit(")"),
    )


def example_rows(links: DataFrame, n: int, authority_label: str = "AS") -> DataFrame:
    """The ``n`` best distinct link examples of every referring domain: live first, then by authority.

    Examples that may occur again are folded first; after that no map task sends more than ``n`` rows per domain. All others are
    never exchanged as a whole. ``links`` are read three times: give a stored table.
    """
    c = F.col
    order = F.struct(c("is_lost").alias("lost"), (-c("page_ascore")).alias("minus"), c("source_url").alias("url"))
    rows = links.select(
        F.lower(F.trim("ref_domain")).alias("domain"), link_example(authority_label).alias("example"), order.alias("o")
    )
    once, again = set_apart(rows.withColumn("_digest", F.xxhash64("domain", "example")), "_digest")
    folded = again.groupBy("domain", "example").agg(F.min("o").alias("o"))
    return top_per_group(once.drop("_digest").unionByName(folded), ["domain"], ["o", "example"], n)


def domain_examples(links: DataFrame, n: int = 20, authority_label: str = "AS", separator: str = "\n") -> DataFrame:
    """Link examples of every domain as one text of at most ``n`` lines."""
    ranked = example_rows(links, n, authority_label)
    lines = F.array_sort(F.collect_list(F.struct("o", "example")))
    return ranked.groupBy("domain").agg(
        F.array_join(F.transform(lines, lambda e: e["example"]), separator).alias("examples"),
        F.count(F.lit(1)).alias("n_examples"),
    )


def intel_payload(links: DataFrame, examples: int = 5) -> DataFrame:
    """Rows of the domain-intelligence export."""
    c = F.col
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "example"))), lambda e: e["example"])
    best = example_rows(links, examples).groupBy("domain").agg(lines.alias("examples"))
    return domain_measures(links).join(best, "domain", "left").select(
        c("domain").alias("ref_domain"),
        c("alpha").alias("competitor_overlap_alpha"),
        F.split("competitors", ", ").alias("competitors"),
        "backlinks",
        "live_backlinks",
        half_up(c("max_page_as"), 1).alias("max_source_page_as"),
        half_up(c("avg_page_as"), 1).alias("avg_source_page_as"),
        *[half_up(c(r), 4).alias(r) for r in ("follow_rate", "sitewide_rate", "sponsored_rate", "ugc_rate")],
        "earliest_first_seen",
        "latest_last_seen",
        "examples",
    )


def ordered_facts(links: DataFrame) -> DataFrame:
    """Link facts by competitor, referring domain and source URL, sorted in parallel ranges."""
    return links.orderBy("competitor_domain", "ref_domain", "source_url", "link_fingerprint")


def link_details(links: DataFrame) -> DataFrame:
    """Every link with its derived columns and the overlap of its domain."""
    alpha = (
        links.groupBy("ref_domain", "competitor_domain").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ref_domain").agg(F.count(F.lit(1)).alias("alpha"))
    )
    return links.join(alpha, "ref_domain", "left").withColumns(
        {
            "alpha": F.coalesce("alpha", F.lit(1).cast("bigint")),
            "state": F.when(F.col("is_lost"), "LOST").otherwise("LIVE"),
            "follow": F.when(link_follows(), "Follow").otherwise("Attributed"),
            "link_type": link_type(),
            "authority_band": authority_band(F.col("page_ascore")),
        }
    )


def diagnostics(profile: DataFrame) -> DataFrame:
    """Six levels read from :func:`competitor_profile`."""
    c = F.col
    loss_links = ratio(c("lost_backlinks"), c("total_backlinks"))
    loss_domains = ratio(c("lost_domains"), c("total_domains"))
    return profile.select(
        "competitor_domain",
        loss_links.alias("backlink_loss"),
        level(loss_links, rules.LOSS_LEVELS).alias("backlink_loss_level"),
        loss_domains.alias("domain_loss"),
        level(loss_domains, rules.LOSS_LEVELS).alias("domain_loss_level"),
        level(c("follow_rate_live"), rules.FOLLOW_LEVELS).alias("follow_level"),
        level(c("sitewide_rate_live"), rules.SITEWIDE_LEVELS).alias("sitewide_level"),
        level(c("high_as_rate_live"), rules.AUTHORITY_LEVELS).alias("authority_level"),
        level(c("live_link_concentration"), rules.CONCENTRATION_LEVELS).alias("concentration_level"),
    )
