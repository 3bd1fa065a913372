"""Vendor B action queue: drop detection, acquisition path, machine score, ranked queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.classify import mask_words, pattern_masks, under_domain
from rankloom.functions.ladders import enrichment_status, priority_label, priority_rank
from rankloom.functions.numbers import rounded
from rankloom.functions.scores import blend_or_machine, machine_breakdown, machine_score, written_score
from rankloom.operators.link_intel import EVIDENCE_WORDS, domain_evidence, domain_examples, domain_measures, domain_rollup, mask_columns
from rankloom.operators.link_queue import with_handoff
from rankloom.operators.ranking import with_batches

METRICS = ("authority_score", "monthly_visits", "organic_traffic", "organic_keywords")


def merge_enrichment(rows: DataFrame) -> DataFrame:
    """One row per domain: the largest known value of each metric and the files it came from."""
    return rows.filter(F.col("domain") != "").groupBy("domain").agg(
        *[F.max(m).alias(m) for m in METRICS],
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )


def drop_reasons() -> dict[str, Column]:
    """Structural reasons to drop a domain, over the measures of the domain rollup."""
    c = F.col
    all_assets = c("assets") == c("backlinks")
    half = F.greatest(F.lit(1), F.floor(c("backlinks") / 2))
    return {
        "self": c("own") > 0,
        "redirect": c("domain").isin(*rules.REDIRECT_HOSTS),
        "cdn": under_domain(c("domain"), rules.CDN_HOSTS),
        "assets": all_assets,
        "technical": ~all_assets & (c("technicals") == c("backlinks")) & (c("assets") >= half),
    }


def drop_evidence(measures: DataFrame, links: DataFrame) -> DataFrame:
    """Add what the texts of a domain's links hold, and the reasons to drop it, to its measures."""
    rollup = measures.join(domain_evidence(links), "domain")
    found = [F.when(test, F.lit(rules.DROP_REASONS[name])) for name, test in drop_reasons().items()]
    return rollup.withColumn("drop_reasons", F.concat_ws(rules.EVIDENCE_JOIN, *found)).withColumn(
        "is_drop", F.col("drop_reasons") != ""
    )


def drop_detection(links: DataFrame) -> DataFrame:
    """Domains that cannot be acted on, with the reasons."""
    return drop_evidence(domain_rollup(links), links).select("domain", "backlinks", "assets", "technicals", "is_drop", "drop_reasons")


def _words(name: str, limit: int) -> Column:
    return mask_words([F.col(m) for m in mask_columns(name)], EVIDENCE_WORDS[name], limit)


def _labelled(label: str, words: Column) -> Column:
    return F.concat(F.lit(rules.EVIDENCE[label]), words)


def classified(measures: DataFrame, brand: str = "our product") -> DataFrame:
    """Add the acquisition path of every domain: priority, confidence, method, action and evidence."""
    c = F.col
    domain = c("domain")
    with_domain = measures.withColumns(
        {
            column: c(column).bitwiseOR(mask)
            for name, words in EVIDENCE_WORDS.items()
            for column, mask in zip(mask_columns(name), pattern_masks(domain, words))
        }
    ).withColumns(
        {
            "hint_words": mask_words(pattern_masks(domain, rules.DIRECTORY_DOMAINS), rules.DIRECTORY_DOMAINS, 4),
            "is_app": under_domain(domain, rules.APP_DOMAINS),
            "is_media": under_domain(domain, rules.MEDIA_DOMAINS),
            "is_edu_gov": domain.rlike(rules.STRATEGIC_TLD),
        }
    )
    has = lambda name: reduce(Column.__or__, [c(m) != 0 for m in mask_columns(name)])
    strategic_domain = c("is_app") | c("is_media") | c("is_edu_gov")
    path = (
        F.when(c("is_drop"), "drop")
        .when(strategic_domain | has("strategic"), "strategic")
        .when(has("self_serve"), "self_serve")
        .when(has("directory") | (c("hint_words") != ""), "directory")
        .when(has("official"), "official")
        .when(has("editorial"), "editorial")
        .otherwise("unverified")
    )
    confidence = F.when((c("path") == "strategic") & strategic_domain, rules.PATH_CONFIDENCE["strategic_domain"])
    for name, value in rules.PATH_CONFIDENCE.items():
        confidence = confidence.when(c("path") == name.replace("strategic_words", "strategic"), value)
    evidence = {
        "drop": c("drop_reasons"),
        "strategic": F.concat_ws(
            rules.EVIDENCE_JOIN,
            F.when(c("is_app"), rules.EVIDENCE["app"]),
            F.when(c("is_edu_gov"), rules.EVIDENCE["tld"]),
            F.when(c("is_media"), rules.EVIDENCE["media"]),
            F.when(has("strategic"), _labelled("strategic", _words("strategic", 6))),
        ),
        "self_serve": _labelled("self_serve", _words("self_serve", 8)),
        "directory": F.concat_ws(
            rules.EVIDENCE_JOIN,
            F.when(has("directory"), _labelled("directory", _words("directory", 6))),
            F.when(c("hint_words") != "", _labelled("directory_domain", c("hint_words"))),
        ),
        "official": _labelled("official", _words("official", 8)),
        "editorial": _labelled("editorial", _words("editorial", 8)),
        "unverified": F.lit(rules.EVIDENCE["none"]),
    }
    pick = lambda values: F.coalesce(*[F.when(c("path") == key, value) for key, value in values.items()])
    texts = {
        column: pick({key: F.lit(row[field].replace("{brand}", brand)) for key, row in rules.PATHS.items()})
        for column, field in (("priority", 0), ("machine_method", 1), ("action_suggested", 2))
    }
    return (
        with_domain.withColumn("path", path)
        .withColumns({**texts, "confidence": confidence, "evidence": pick(evidence)})
        .drop("hint_words", "is_app", "is_media", "is_edu_gov", *[m for name in EVIDENCE_WORDS for m in mask_columns(name)])
    )


def action_path(links: DataFrame, brand: str = "our product") -> DataFrame:
    """Acquisition path of every referring domain."""
    rollup = drop_evidence(domain_rollup(links), links)
    return classified(rollup, brand).select(
        "domain", "path", "priority", "confidence", "machine_method", "action_suggested", "evidence"
    )


def with_enrichment(measures: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Attach the domain metrics; a domain without them keeps NULL, which is not zero."""
    c = F.col
    metrics = enrichment.select(
        "domain",
        c("authority_score").alias("domain_authority_score"),
        "monthly_visits",
        "organic_traffic",
        "organic_keywords",
        F.array_join("source_files", ", ").alias("traffic_source"),
    )
    return measures.join(metrics, "domain", "left").withColumns(
        {
            "traffic_source": F.coalesce("traffic_source", F.lit("")),
            "traffic_status": enrichment_status(
                c("domain_authority_score"), c("monthly_visits"), c("organic_traffic")
            ),
        }
    )


def scored_domains(links: DataFrame, enrichment: DataFrame, brand: str = "our product") -> DataFrame:
    """Every referring domain with its summary, path and machine score (at most 25 for dropped ones)."""
    c = F.col
    summary = with_enrichment(drop_evidence(domain_measures(links), links), enrichment)
    scored = classified(summary, brand).withColumns(
        {"raw_score": machine_score(), "score_breakdown": machine_breakdown()}
    )
    return scored.withColumns(
        {
            "machine_score": F.when(c("priority") == "Drop", F.least(c("raw_score"), F.lit(25.0))).otherwise(
                c("raw_score")
            ),
            "priority_label": priority_label(c("priority")),
            "priority_rank": priority_rank(c("priority")),
            "total_links": F.format_string("总计:%d | %s", c("backlinks"), c("per_competitor")),
        }
    )


QUEUE_COLUMNS = (
    "priority", "priority_label", "priority_rank", "domain", "machine_score", "score_breakdown", "confidence",
    "machine_method", "action_suggested", "evidence", "alpha", "competitors", "total_links", "backlinks",
    "live_backlinks", "live_rate", "source_pages", "target_pages", "domain_authority_score", "max_page_as",
    "avg_page_as", "live_avg_page_as", "high_page_as_rate", "organic_traffic", "monthly_visits",
    "organic_keywords", "traffic_status", "traffic_source", "follow_rate", "live_follow_rate", "sitewide_rate",
    "sponsored_rate", "ugc_rate", "avg_external_links", "earliest_first_seen", "latest_last_seen",
)


HANDOFF_BLANKS = (
    "ai_priority", "ai_relevance", "ai_method", "ai_conclusion", "ai_pitch", "email", "entry_url", "live_url",
    "verified_on", "notes",
)


def final_score(queue: DataFrame) -> DataFrame:
    """Add ``final_score``: the machine's score, blended with the relevance once one is written."""
    relevance = written_score(F.col("ai_relevance"))
    return queue.withColumn("final_score", blend_or_machine(F.col("machine_score"), relevance))


def queue_order() -> list[Column]:
    c = F.col
    return [
        c("priority_rank").asc(),
        c("machine_score").desc(),
        F.coalesce("domain_authority_score", "max_page_as").desc(),
        F.coalesce("organic_traffic", F.lit(-1.0)).desc(),
        c("alpha").desc(),
        c("domain").asc(),
    ]


def action_queue(links: DataFrame, enrichment: DataFrame, brand: str = "our product", samples: int = 10) -> DataFrame:
    """The ranked action queue with sample links, hand-off columns and final score."""
    queue = scored_domains(links, enrichment, brand).select(*QUEUE_COLUMNS)
    texts = domain_examples(links, samples, "Page AS", "\n\n").select("domain", F.col("examples").alias("sample_links"))
    ranked = rounded(queue.join(texts, "domain", "left")).orderBy(*queue_order())
    return final_score(with_handoff(ranked, HANDOFF_BLANKS, rules.HANDOFF_STATES_B))


def unenriched(scored: DataFrame) -> DataFrame:
    """Actionable domains without any domain metric."""
    c = F.col
    return scored.filter(
        (c("priority") != "Drop")
        & c("domain_authority_score").isNull()
        & c("organic_traffic").isNull()
        & c("monthly_visits").isNull()
    )


def unenriched_batches(scored: DataFrame, size: int = 200) -> DataFrame:
    """The list of un-enriched domains in queue order, cut into batches."""
    missing = unenriched(scored).select(
        "domain", "priority_rank", "machine_score", "max_page_as", "alpha", "domain_authority_score", "organic_traffic"
    )
    return with_batches(missing, queue_order(), size).select("batch_no", "row_no", "domain")


def priority_counts(scored: DataFrame) -> DataFrame:
    """Domains per priority and how many of them carry domain metrics."""
    return scored.groupBy("priority").agg(
        F.count(F.lit(1)).alias("n_domains"),
        F.count_if(F.col("traffic_status") != rules.ENRICHMENT_NONE).cast("bigint").alias("n_enriched"),
    )
