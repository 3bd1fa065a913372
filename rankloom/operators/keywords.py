"""Keyword facts: competitor profiles, rankings, overlap, queue and page tasks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.classify import page_plan, plan_text
from rankloom.functions.ladders import at_least, difficulty_band, rank_band
from rankloom.functions.numbers import exact, exact_sum, half_up, ratio
from rankloom.functions.scores import keyword_score, new_site_keyword_score
from rankloom.functions.text import capitalised, joined, slug, title_case
from rankloom.operators.link_queue import final_v2, with_handoff
from rankloom.operators.ranking import number_rows, top_per_group

INTENTS = ("navigational", "informational", "commercial", "transactional")
RANK_BANDS = {"1-3": "pos_1_3", "4-10": "pos_4_10", "11-20": "pos_11_20", "21+": "pos_21_plus"}
KD_BANDS = {"0-15": "kd_0_15", "16-40": "kd_16_40", "41+": "kd_41_plus"}


def _traffic_where(test: Column) -> Column:
    return F.sum(F.when(test, exact(F.col("current_traffic"))).otherwise(F.lit(0).cast("decimal(24,6)")))


def intent_shares() -> dict[str, Column]:
    """Traffic of a row divided equally over its intents, NULL for an intent it does not have."""
    flags = [F.col(f"is_{i}").cast("int") for i in INTENTS]
    n = sum(flags[1:], flags[0])
    return {
        i: F.when(flag == 1, F.col("current_traffic") / n) for i, flag in zip(INTENTS, flags)
    }


def keyword_profile(keywords: DataFrame) -> DataFrame:
    """Traffic of every competitor by brand, intent, rank and difficulty, in one pass."""
    c = F.col
    zero = F.lit(0).cast("decimal(24,6)")
    position, kd = rank_band(c("current_position")), difficulty_band(c("kd"))
    measures = {
        "n_keywords": F.count_if(c("keyword") != "").cast("bigint"),
        "traffic": exact_sum(c("current_traffic")).cast("double"),
        "traffic_value": half_up(exact_sum(c("current_traffic") * c("cpc")), 4),
        "branded_traffic": _traffic_where(c("is_branded")).cast("double"),
        "non_branded_traffic": _traffic_where(~c("is_branded")).cast("double"),
    }
    for intent, share in intent_shares().items():
        measures[f"intent_{intent}"] = half_up(F.sum(F.coalesce(exact(share), zero)), 4)
    for band, name in RANK_BANDS.items():
        measures[name] = _traffic_where(position == band).cast("double")
    for band, name in KD_BANDS.items():
        measures[name] = _traffic_where(kd == band).cast("double")
    return keywords.groupBy("competitor_domain").agg(*[value.alias(name) for name, value in measures.items()])


def keyword_shares(profile: DataFrame) -> DataFrame:
    """Shares of the traffic of a competitor; 0 when it has none."""
    c = F.col
    whole = F.when(c("traffic") > 0, c("traffic")).otherwise(1.0)
    parts = {
        "non_branded_share": c("non_branded_traffic"),
        "branded_share": c("branded_traffic"),
        "buying_share": c("intent_commercial") + c("intent_transactional"),
        **{f"{name}_share": c(name) for name in [*(f"intent_{i}" for i in INTENTS), *RANK_BANDS.values(), *KD_BANDS.values()]},
    }
    return profile.select(
        "competitor_domain", *[half_up(ratio(part, whole), 6).alias(name) for name, part in parts.items()]
    )


def country_traffic(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("competitor_domain", "country").agg(
        exact_sum(F.col("current_traffic")).cast("double").alias("traffic")
    )


def _competitor_share(top: DataFrame, keywords: DataFrame) -> DataFrame:
    """Traffic of the ranked rows as a share of all traffic of their competitor."""
    totals = keywords.groupBy("competitor_domain").agg(
        exact_sum(F.col("current_traffic")).cast("double").alias("_total")
    )
    whole = F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)
    return (
        top.join(totals, "competitor_domain")
        .withColumn("traffic_share", half_up(ratio(F.col("traffic"), whole), 6))
        .drop("_total")
    )


def top_countries(keywords: DataFrame, n: int = 5) -> DataFrame:
    ranked = top_per_group(country_traffic(keywords), ["competitor_domain"], [F.desc("traffic"), "country"], n)
    return _competitor_share(ranked, keywords)


def page_keywords(keywords: DataFrame) -> DataFrame:
    """Traffic per competitor, landing page and keyword."""
    return (
        keywords.filter(F.col("url") != "")
        .groupBy("competitor_domain", "url", "keyword")
        .agg(exact_sum(F.col("current_traffic")).alias("kw_traffic"))
    )


def top_landing_pages(keywords: DataFrame, n: int = 10, sample: int = 5) -> DataFrame:
    """Strongest landing pages of every competitor with a sample of their keywords.

    Keywords are sampled for the ranked pages only, so no page ever gathers all of its keywords.
    """
    c = F.col
    per_keyword = page_keywords(keywords)
    pages = per_keyword.groupBy("competitor_domain", "url").agg(
        F.sum("kw_traffic").cast("double").alias("traffic"), F.count(F.lit(1)).alias("n_keywords")
    )
    ranked = top_per_group(pages, ["competitor_domain"], [F.desc("traffic"), "url"], n)
    page = ["competitor_domain", "url"]
    samples = (
        top_per_group(
            per_keyword.join(ranked.select(*page), page, "left_semi").select(*page, "keyword"), page, ["keyword"], sample
        )
        .groupBy(*page)
        .agg(joined(F.collect_list("keyword"), ", ").alias("keyword_sample"))
    )
    return _competitor_share(ranked.join(samples, page), keywords).select(
        *page, c("traffic"), "n_keywords", "keyword_sample", "traffic_share"
    )


def top_terms(keywords: DataFrame, n: int = 10, worst_position: int = 50) -> DataFrame:
    """Strongest non-branded rankings of every competitor."""
    c = F.col
    eligible = keywords.filter(
        (c("current_traffic") > 0) & (c("current_position") <= worst_position) & ~c("is_branded")
    )
    return top_per_group(
        eligible, ["competitor_domain"], [F.desc("current_traffic"), "keyword", "country", "src_ord"], n
    ).select(
        "competitor_domain", "keyword", "country", "volume", "kd", "cpc", "current_position", "current_traffic", "url"
    )


def keyword_overlap(keywords: DataFrame) -> DataFrame:
    """Non-branded keywords with traffic: how many competitors rank, and the figures of the first row seen.

    Folding to one row per keyword and competitor first keeps a hot keyword from meeting in one task.
    """
    c = F.col
    figures = F.struct(
        "src_ord", "volume", "kd", "cpc", *[f"is_{i}" for i in ("informational", "commercial", "transactional")]
    )
    per_pair = (
        keywords.filter(~c("is_branded") & (c("current_traffic") > 0))
        .groupBy("keyword", "competitor_domain")
        .agg(exact_sum(c("current_traffic")).alias("t"), F.min(figures).alias("f"))
    )
    return (
        per_pair.groupBy("keyword")
        .agg(
            F.count(F.lit(1)).alias("alpha"),
            F.sum("t").cast("double").alias("traffic"),
            F.min("f").alias("f"),
            joined(F.collect_list("competitor_domain"), ", ").alias("shared_by"),
        )
        .select(
            "keyword",
            "alpha",
            "shared_by",
            c("f.volume").alias("volume"),
            c("f.kd").alias("kd"),
            c("f.cpc").alias("cpc"),
            "traffic",
            c("f.is_informational").alias("is_informational"),
            c("f.is_commercial").alias("is_commercial"),
            c("f.is_transactional").alias("is_transactional"),
        )
    )


def keyword_matrix(overlap: DataFrame, limit: int | None = None) -> DataFrame:
    """All shared keywords, most competitors first; ``limit`` cuts the table for a sheet."""
    ordered = overlap.orderBy(F.desc("alpha"), F.desc("traffic"), F.asc("kd"), F.asc("keyword"))
    top = ordered.limit(limit) if limit else ordered
    return top.select("keyword", "alpha", "shared_by", "volume", "kd", "cpc", "traffic")


def keyword_scores(overlap: DataFrame) -> DataFrame:
    """Score, priority and action of every keyword of :func:`keyword_overlap`."""
    c = F.col
    action = (
        F.when(c("is_transactional") | c("is_commercial"), rules.KEYWORD_ACTION_BUYING)
        .when(c("is_informational"), rules.KEYWORD_ACTION_INFORMATION)
        .otherwise(rules.KEYWORD_ACTION_DEFAULT)
    )
    scored = overlap.withColumn("auto_score", keyword_score(c("alpha"), c("kd"), c("volume"), c("cpc")))
    return scored.withColumns(
        {
            "priority": at_least(c("auto_score"), rules.KEYWORD_PRIORITIES, rules.KEYWORD_PRIORITY_LAST),
            "action": action,
        }
    )


def keyword_queue(overlap: DataFrame, limit: int | None = None) -> DataFrame:
    """All scored keywords, best first; ``limit`` cuts the table for a sheet."""
    ordered = keyword_scores(overlap).orderBy(F.desc("auto_score"), F.desc("traffic"), F.asc("keyword"))
    top = ordered.limit(limit) if limit else ordered
    blanks = ("ai_relevance", "ai_title", "ai_outline", "editor", "published_url")
    rows = top.select(
        "priority", "keyword", "auto_score", "action", "alpha", "volume", "kd", "cpc", "traffic", "shared_by"
    )
    return final_v2(with_handoff(rows, blanks, {"status": rules.NOT_STARTED}))


def keyword_view(keywords: DataFrame) -> DataFrame:
    """Non-branded keywords for the task list: figures of the largest market, intents of the first row."""
    c = F.col
    market = F.struct(
        (-F.greatest(c("volume"), F.lit(0).cast("bigint"))).alias("minus_volume"), "src_ord", "kd", "cpc"
    )
    first = F.struct("src_ord", "is_commercial", "is_transactional", "is_navigational", "is_informational")
    per_pair = (
        keywords.filter(~c("is_branded"))
        .groupBy("keyword", "competitor_domain")
        .agg(exact_sum(c("current_traffic")).alias("t"), F.min(market).alias("m"), F.min(first).alias("f"))
    )
    return (
        per_pair.groupBy("keyword")
        .agg(
            F.sum("t").cast("double").alias("traffic"),
            F.min("m").alias("m"),
            F.min("f").alias("f"),
            joined(F.collect_list(capitalised(c("competitor_domain"))), ", ").alias("competitors"),
        )
        .select(
            "keyword",
            (-c("m.minus_volume")).alias("volume"),
            c("m.kd").alias("kd"),
            c("m.cpc").alias("cpc"),
            "traffic",
            "competitors",
            c("f.is_commercial").alias("is_commercial"),
            c("f.is_transactional").alias("is_transactional"),
            c("f.is_navigational").alias("is_navigational"),
            c("f.src_ord").alias("first_ord"),
        )
    )


def keyword_benchmarks(keywords: DataFrame) -> DataFrame:
    """Competing pages of every non-branded keyword, their traffic summed over countries.

    One row per page: a keyword with very many pages stays spread over the cluster.
    """
    c = F.col
    return (
        keywords.filter(~c("is_branded") & (c("current_traffic") > 0) & (c("url") != ""))
        .groupBy("keyword", "url")
        .agg(
            F.min(F.struct("src_ord", "competitor_domain")).alias("first"),
            exact_sum(c("current_traffic")).cast("double").alias("traffic"),
        )
        .select("keyword", "url", capitalised(c("first.competitor_domain")).alias("competitor"), "traffic")
        .withColumn("benchmark", benchmark_text())
    )


def benchmark_text() -> Column:
    return F.format_string(
        "[%s] %s (Traffic: %s)", F.col("competitor"), F.col("url"), exact(F.col("traffic"), 1).cast("string")
    )


def ranked_benchmarks(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.orderBy(F.asc("keyword"), F.desc("traffic"), F.asc("url"))


def scored_tasks(keywords: DataFrame, brand: str = "our product", least_score: float = 50) -> DataFrame:
    """Keywords worth a page, with the page to build, before they are numbered."""
    c = F.col
    buying = c("is_commercial") | c("is_transactional")
    view = keyword_view(keywords).withColumn(
        "score", new_site_keyword_score(c("volume"), c("kd"), c("cpc"), buying)
    )
    plan = page_plan(c("keyword"), c("is_commercial"), c("is_transactional"), c("is_navigational"))
    suffix = f" {rules.TITLE_SUFFIX} | {brand}"
    return (
        view.filter(c("score") >= least_score)
        .withColumn("plan", plan)
        .withColumns(
            {
                "page_type": plan_text(c("plan"), 0, brand),
                "department": plan_text(c("plan"), 1, brand),
                "instruction": plan_text(c("plan"), 2, brand),
                "target_url": F.concat(plan_text(c("plan"), 3, brand), slug(c("keyword"))),
                "title": F.concat(title_case(c("keyword")), F.lit(suffix)),
                "traffic": half_up(c("traffic"), 1),
            }
        )
        .drop("plan", "is_commercial", "is_transactional", "is_navigational")
    )


def keyword_tasks(
    keywords: DataFrame, brand: str = "our product", discovered: str = "", prefix: str = "SEO-PAGE-"
) -> DataFrame:
    """Page tasks numbered in the order their keywords first appeared, best first."""
    numbered = number_rows(scored_tasks(keywords, brand), ["first_ord", "keyword"], "task_no")
    return (
        numbered.withColumns(
            {
                "task_id": F.concat(
                    F.lit(prefix),
                    F.when(F.col("task_no") < 10000, F.lpad(F.col("task_no").cast("string"), 4, "0")).otherwise(
                        F.col("task_no").cast("string")
                    ),
                ),
                "discovered": F.lit(discovered),
                "completed": F.lit(""),
                "status": F.lit("Pending"),
            }
        )
        .drop("first_ord", "task_no")
        .orderBy(F.desc("score"), F.desc("traffic"), F.asc("keyword"))
    )


def brand_free(keywords: DataFrame, keyword: str = "keyword", competitor: str = "competitor_domain") -> DataFrame:
    """Keywords that do not hold the name of their competitor, blanks ignored."""
    return keywords.filter(~F.contains(F.replace(F.col(keyword), F.lit(" "), F.lit("")), F.col(competitor)))


