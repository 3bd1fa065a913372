"""Smaller inputs: domain metrics, page metrics, target sites, prospects, mail templates, stored facts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.numbers import lenient_double, metric_double
from rankloom.functions.text import BOM, strip
from rankloom.functions.urls import any_www_host, hostname, sitemap_url
from rankloom.sources.exports import Fields, inspect, list_files, read_exports


def header_words(name: str) -> tuple[str, ...]:
    """The words of a header in lower case; blanks, underscores, hyphens, slashes and brackets part them."""
    return tuple(w for w in re.split(r"[\s_\-()/]+", (name or "").replace(BOM, " ").lower()) if w)


def rank_header(header: Sequence[str], aliases: Sequence[Sequence[str]]) -> int | None:
    """How well the words of a header fit: the number of the alias they equal, after all of those a header that begins or
    ends with the words of an alias, None for any other."""
    for rank, alias in enumerate(aliases):
        if header == alias:
            return rank
    touches = (header[: len(a)] == a or header[-len(a) :] == a for a in aliases if a)
    return len(aliases) if any(touches) else None


def settle_headers(headers: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The best-ranked header of every measure that has one; of equally good ones the first, of equal names the last."""
    words = {header_words(h): h for h in headers}
    found = {}
    for measure, names in wanted.items():
        aliases = [header_words(n) for n in names]
        ranks = [(rank, place, h) for place, (w, h) in enumerate(words.items()) if (rank := rank_header(w, aliases)) is not None]
        if ranks:
            found[measure] = min(ranks)[2]
    return found


def _metrics(rows: DataFrame, f: Fields) -> DataFrame:
    metrics = {
        "authority_score": rules.AUTHORITY_HEADERS,
        "monthly_visits": rules.VISITS_HEADERS,
        "organic_traffic": rules.TRAFFIC_HEADERS,
        "organic_keywords": rules.KEYWORDS_HEADERS,
    }
    found = settle_headers(list(f.raw), {"domain": rules.DOMAIN_HEADERS, **metrics})
    cell = lambda name: F.col(f.raw[found[name]]) if name in found else F.lit(None).cast("string")
    return rows.select(
        F.coalesce(hostname(cell("domain")), F.lit("")).alias("domain"),
        *[metric_double(cell(name)).alias(name) for name in metrics],
        F.col("src_file").alias("source_file"),
    ).filter(F.col("domain") != "")


def read_enrichment(spark: SparkSession, folder: str) -> DataFrame | None:
    """Domain metrics of all files, one row per line; merge with ``merge_enrichment``."""
    files = inspect(spark, list_files(spark, folder, "*.*sv"), latin1_fallback=True)
    return read_exports(spark, [f for f in files if len(f.headers) > 1], _metrics)


#: What names a page measure: (measure, test on the lower-cased header, rank). The best rank counts, then the last header
#: of a name that says "current", and the first of a plain one.
_PAGE_MEASURES = (
    ("url", r"url", 0),
    ("traffic", r"(?=.*current).*traffic.*", 0),
    ("traffic", r"traffic", 1),
    ("keywords", r"(?=.*current)(?!.*traffic).*keywords.*", 0),
    ("keywords", r"keywords", 1),
    ("top_keyword", r"(current )?top keyword", 0),
)


def _page_fields(headers: Sequence[str]) -> dict[str, str]:
    fits = [
        (measure, rank, -place if rank == 0 else place, header)
        for place, header in enumerate(headers)
        for measure, test, rank in _PAGE_MEASURES
        if re.fullmatch(test, header.lower())
    ]
    return {measure: header for measure, _, _, header in sorted(fits, reverse=True)}


def file_domain(file_name: Column) -> Column:
    """Domain in front of the export kind in a file name, empty when there is none."""
    found = F.regexp_extract(file_name, r"(?i)^([a-z0-9.\-]+?)-(?:top-pages|organic|subdomains|pages)", 1)
    return F.replace(F.lower(found), F.lit("www."), F.lit(""))


def _page_metrics(rows: DataFrame, f: Fields) -> DataFrame:
    fields = _page_fields(list(f.raw))
    number = lambda name: lenient_double(F.col(f.raw[fields[name]])) if name in fields else F.lit(0.0)
    url = F.col(f.raw[fields["url"]]) if "url" in fields else F.lit(None).cast("string")
    return rows.select(
        file_domain(F.col("src_file")).alias("named_domain"),
        url.alias("metrics_url"),
        number("traffic").alias("traffic"),
        number("keywords").alias("keywords"),
        (F.col(f.raw[fields["top_keyword"]]) if "top_keyword" in fields else F.lit("")).alias("top_keyword"),
        "src_file",
        "src_ord",
        F.col("_metadata.file_path").alias("src_path"),
    ).filter(F.col("metrics_url").isNotNull())


def read_page_metrics(spark: SparkSession, folder: str) -> DataFrame | None:
    """Page metrics of all CSV files below ``folder``; the domain comes from the file name or the file's first URL."""
    files = inspect(spark, list_files(spark, folder, "*.csv", recursive=True), latin1_fallback=True)
    rows = read_exports(spark, [f for f in files if len(f.headers) > 1], _page_metrics)
    if rows is None:
        return None
    # One row per file; files of one name in different folders are different files.
    first = rows.groupBy("src_path").agg(F.min_by("metrics_url", "src_ord").alias("first_url"))
    domain = F.coalesce(F.nullif("named_domain", F.lit("")), any_www_host(F.col("first_url")))
    return rows.join(first, "src_path").select(
        domain.alias("domain"), "metrics_url", "traffic", "keywords", "top_keyword", "src_file", "src_ord"
    )


def read_targets(spark: SparkSession, file: str) -> DataFrame:
    """Target sites, one per line, as distinct sitemap addresses."""
    lines = spark.read.text(file).filter(strip(F.col("value")) != "")
    return lines.select(sitemap_url(F.col("value")).alias("url")).distinct()


def read_template(spark: SparkSession, file: str) -> tuple[str, str]:
    """Subject (first line with text) and body of a mail template."""
    text = spark.read.text(file, wholetext=True).head(1)[0].value
    lines = text.splitlines(keepends=True)
    at = next((i for i, line in enumerate(lines) if line.strip()), None)
    return ("", "") if at is None else (lines[at].strip(), "".join(lines[at + 1 :]).lstrip())


def prospect_names(count: int) -> list[str]:
    """Names of a prospect list without header."""
    extra = [rules.EXTRA_PROSPECT_COLUMN.format(index=i) for i in range(len(rules.PROSPECT_COLUMNS), count)]
    return [*rules.PROSPECT_COLUMNS, *extra][:count]


def read_prospects(spark: SparkSession, file: str, separator: str = ",") -> DataFrame:
    """Prospect list; without a header naming a domain the columns get their standard names."""
    options = spark.read.option("sep", separator).option("multiLine", True).option("escape", '"')
    first = options.option("header", False).csv(file).head(1)
    names = [(v or "").replace(BOM, "").strip() for v in first[0]] if first else []
    titled = any("domain" in n.lower() or "域名" in n for n in names)
    final = [n or f"column_{i}" for i, n in enumerate(names)] if titled else prospect_names(len(names))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return options.option("header", titled).schema(schema).csv(file).toDF(*final)


def contact_columns(names: Sequence[str]) -> tuple[str, str]:
    """First column naming a domain and first column naming an address."""
    domain = next((n for n in names if "domain" in n.lower() or "域名" in n), None)
    email = next((n for n in names if "email" in n.lower() or "邮箱" in n), None)
    if domain is None or email is None:
        raise ValueError("the prospect list needs a domain and an email column")
    return domain, email


def read_link_facts(spark: SparkSession, path: str) -> DataFrame:
    """Stored vendor B facts, checked for the columns the action queue needs."""
    facts = spark.read.parquet(path)
    missing = sorted(set(rules.LINK_FACT_COLUMNS) - set(facts.columns))
    if missing:
        raise ValueError("stored link facts lack columns: " + ", ".join(missing))
    return facts
