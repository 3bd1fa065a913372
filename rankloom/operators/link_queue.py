"""Vendor A execution queues: score, classify and rank referring domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.classify import action_v1, domain_type, text_type
from rankloom.functions.ladders import at_least
from rankloom.functions.scores import blend_three, blend_two, link_score_v1, link_score_v2, written_score
from rankloom.functions.text import anchor_text, joined

Patterns = Mapping[str, Sequence[str]]


def queue_anchor(no_anchor: str) -> Column:
    return anchor_text(F.col("raw_json"), rules.ANCHOR_KEYS_QUEUE, no_anchor, rules.UNREADABLE_ANCHOR)


def link_detail(anchor: Column) -> Column:
    return F.format_string(
        "[%s] %s ---> %s (锚文本: %s)", F.col("competitor_domain"), F.col("ref_url"), F.col("target_url"), anchor
    )


def _first_hit(hit: Column, order: Column) -> Column:
    """Smallest (arrival, category) among the rows that match a category."""
    return F.min(F.when(hit.isNotNull(), F.struct(order.alias("ord"), hit.alias("hit"))))


def domain_stats(links: DataFrame, url_types: Patterns, no_anchor: str) -> DataFrame:
    """Queue measures per referring domain; a domain is spam as soon as one of its links is.

    Facts hold one link per domain and competitor, so a domain lists one link for each competitor.
    """
    anchor = F.col("_anchor")
    per_pair = links.withColumn("_anchor", queue_anchor(no_anchor)).groupBy("ref_domain", "competitor_domain").agg(
        F.sum("links_in_group").alias("links"),
        F.max("domain_rating").alias("rating"),
        F.max("page_traffic").alias("traffic"),
        F.bool_or("is_dofollow").alias("dofollow"),
        F.bool_or("is_spam").alias("spam"),
        F.min(link_detail(anchor)).alias("detail"),
        _first_hit(text_type(F.col("ref_url"), url_types), F.col("src_ord")).alias("url_hit"),
        _first_hit(text_type(anchor, rules.ANCHOR_INTENTS), F.col("src_ord")).alias("anchor_hit"),
    )
    counts = F.format_string("%s:%d", F.col("competitor_domain"), F.col("links"))
    return (
        per_pair.groupBy("ref_domain")
        .agg(
            F.count(F.lit(1)).alias("alpha"),
            F.sum("links").alias("total_links"),
            F.greatest(F.max("rating"), F.lit(0).cast("bigint")).alias("max_dr"),
            F.greatest(F.max("traffic"), F.lit(0).cast("bigint")).alias("max_traffic"),
            F.bool_or("dofollow").alias("any_dofollow"),
            F.bool_or("spam").alias("any_spam"),
            joined(F.collect_list(counts), ", ").alias("per_competitor"),
            joined(F.collect_list("detail"), "\n\n").alias("example_links"),
            F.min("url_hit")["hit"].alias("url_type"),
            F.min("anchor_hit")["hit"].alias("anchor_intent"),
        )
        .withColumn(
            "links_text",
            F.format_string("总计:%d (%s)", F.col("total_links"), F.col("per_competitor")),
        )
        .drop("per_competitor")
    )


def link_types_v1(stats: DataFrame, domain_types: Patterns = rules.LINK_TYPES_V1) -> DataFrame:
    """Type by domain, else by the first matching URL, else the default."""
    found = F.coalesce(domain_type(F.lower("ref_domain"), domain_types), F.col("url_type"))
    return stats.withColumn("link_type", F.coalesce(found, F.lit(rules.DEFAULT_TYPE_V1)))


def link_types_v2(stats: DataFrame, domain_types: Patterns = rules.LINK_TYPES_V2) -> DataFrame:
    """Type with a confidence: domain 1.0, word in the domain 0.9, URL 0.8, default 0.5."""
    domain = F.replace(F.lower("ref_domain"), F.lit("www."), F.lit(""))
    exact = {k: [p for p in v if "." in p] for k, v in domain_types.items()}
    words = {k: [p for p in v if "." not in p] for k, v in domain_types.items()}
    exact_type = domain_type(domain, {k: v for k, v in exact.items() if v})
    word_type = domain_type(domain, {k: v for k, v in words.items() if v})
    by_domain = domain_type(domain, domain_types)
    order = {name: i for i, name in enumerate(domain_types)}
    rank = lambda kind: F.coalesce(_position(kind, order), F.lit(len(order)))
    confidence = (
        F.when(by_domain.isNotNull() & (rank(exact_type) <= rank(word_type)), 100)
        .when(by_domain.isNotNull(), 90)
        .when(F.col("url_type").isNotNull(), 80)
        .otherwise(50)
    )
    return stats.withColumns(
        {
            "link_type": F.coalesce(by_domain, F.col("url_type"), F.lit(rules.DEFAULT_TYPE_V2)),
            "confidence_pct": confidence,
            "anchor_intent": F.coalesce("anchor_intent", F.lit(rules.UNKNOWN_ANCHOR)),
        }
    )


def _position(kind: Column, order: Mapping[str, int]) -> Column:
    picked = F
    for name, place in order.items():
        picked = picked.when(kind == name, place)
    return picked.otherwise(None)


def _score_columns() -> list[Column]:
    return [F.col(c) for c in ("alpha", "max_dr", "max_traffic", "any_dofollow", "any_spam")]


def score_v1(stats: DataFrame) -> DataFrame:
    score = link_score_v1(*_score_columns())
    scored = stats.withColumn("auto_score", score)
    tail = F.when(F.col("auto_score") > 0, rules.PRIORITY_TAIL_V1).otherwise(rules.PRIORITY_SPAM_V1)
    return scored.withColumn("priority", at_least(F.col("auto_score"), rules.PRIORITIES_V1, tail))


def score_v2(stats: DataFrame) -> DataFrame:
    return stats.withColumn("auto_score", link_score_v2(*_score_columns()))


def tiers_v2(scored: DataFrame) -> DataFrame:
    """Tier by effort and value: trash, batch work, direct approach or outreach."""
    c = F.col
    batch = c("link_type").isin(*rules.BATCHABLE_TYPES)
    top = c("link_type").isin(*rules.TOP_TIER_TYPES)
    tier = (
        F.when(c("any_spam") | ((c("max_dr") < 10) & (c("max_traffic") == 0)), "trash")
        .when(batch | (c("max_dr") < 40), "C")
        .when(top, "A")
        .otherwise("B")
    )
    action = (
        F.when(c("tier") == "trash", "trash")
        .when((c("tier") == "C") & batch, "C_batch")
        .when(c("tier") == "C", "C_small")
        .when(c("tier") == "B", "B")
        .when(c("link_type") == "App Marketplace", "A_app")
        .when(c("link_type") == "Media", "A_media")
        .otherwise("A_other")
    )
    lookup = lambda key, table: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])
    return (
        scored.withColumn("tier", tier)
        .withColumn("action_key", action)
        .withColumns(
            {
                "tier_rank": lookup(c("tier"), {k: v[0] for k, v in rules.TIERS_V2.items()}),
                "tier_label": lookup(c("tier"), {k: v[1] for k, v in rules.TIERS_V2.items()}),
                "action": lookup(c("action_key"), rules.ACTIONS_V2),
                "type_label": F.format_string(
                    "%s%s (%d%%)",
                    c("link_type"),
                    F.when(c("action_key") == "C_small", rules.DOWNGRADE_SUFFIX).otherwise(""),
                    c("confidence_pct"),
                ),
            }
        )
        .drop("action_key")
    )


def with_handoff(queue: DataFrame, blanks: Sequence[str], status: Mapping[str, str]) -> DataFrame:
    """Empty columns for the people and tools that work on the queue, plus default states."""
    return queue.withColumns({**{b: F.lit("") for b in blanks}, **{k: F.lit(v) for k, v in status.items()}})


def answered(queue: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The queue with what people and tools wrote into its hand-off columns, and no final score any more.

    ``answers`` has ``key`` and any of the queue's other columns, one row per key; null there leaves the queue's value.
    """
    given = [c for c in answers.columns if c != key]
    told = answers.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in given))
    merged = queue.join(told, F.col(key) == F.col("_key"), "left")
    merged = merged.withColumns({c: F.coalesce(F.col(f"_{c}").cast(queue.schema[c].dataType), F.col(c)) for c in given})
    return merged.drop("_key", "final_score", *(f"_{c}" for c in given))


def final_v1(queue: DataFrame) -> DataFrame:
    """Add ``final_score``: the machine's score with the written relevance and difficulty."""
    c = F.col
    relevance, difficulty = written_score(c("ai_relevance")), written_score(c("human_difficulty"))
    return queue.withColumn("final_score", blend_three(c("auto_score"), relevance, difficulty))


def final_v2(queue: DataFrame) -> DataFrame:
    """Add ``final_score``: the machine's score with the written relevance."""
    return queue.withColumn("final_score", blend_two(F.col("auto_score"), written_score(F.col("ai_relevance"))))


def queue_v1(links: DataFrame, brand: str = "our product") -> DataFrame:
    """First execution queue, best opportunities first."""
    stats = domain_stats(links, rules.URL_TYPES_V1, rules.NO_ANCHOR_V1)
    queue = score_v1(link_types_v1(stats)).withColumn("action", action_v1(F.col("link_type"), brand))
    ranked = queue.orderBy(
        F.desc("auto_score"), F.desc("max_dr"), F.desc("max_traffic"), F.asc("ref_domain")
    ).select(
        "priority",
        "ref_domain",
        "auto_score",
        "link_type",
        "action",
        "alpha",
        "links_text",
        "max_dr",
        "max_traffic",
        "any_dofollow",
        "any_spam",
        "example_links",
    )
    handed = with_handoff(
        ranked,
        ["ai_relevance", "ai_content", "ai_difficulty", "human_difficulty", "email", "contact_url"],
        {"status": rules.NOT_STARTED},
    )
    return final_v1(handed)


def queue_v2(links: DataFrame) -> DataFrame:
    """Second execution queue: tier first, then score."""
    stats = domain_stats(links, rules.URL_TYPES_V2, rules.NO_ANCHOR)
    queue = tiers_v2(score_v2(link_types_v2(stats)))
    ranked = queue.orderBy(F.asc("tier_rank"), F.desc("auto_score"), F.desc("max_dr"), F.asc("ref_domain")).select(
        "tier_rank",
        "tier_label",
        "ref_domain",
        "auto_score",
        "type_label",
        "action",
        "alpha",
        "links_text",
        "max_dr",
        "max_traffic",
        "any_dofollow",
        "any_spam",
        "example_links",
    )
    handed = with_handoff(
        ranked,
        ["ai_relevance", "ai_content", "ai_difficulty", "email", "entry_url"],
        {"review": "Pending", "status": rules.NOT_STARTED},
    )
    return final_v2(handed)
