"""From normalised link rows to stored facts: registrable domains, fingerprints, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import first_wins, first_wins_apart

FINGERPRINT_FLAGS = ("is_nofollow", "is_sponsored", "is_ugc", "is_text", "is_frame", "is_form", "is_image")


def fingerprint() -> Column:
    """SHA-1 of what makes two links the same: URLs, anchor and placement, case ignored."""
    flags = [F.col(f).cast("int").cast("string") for f in FINGERPRINT_FLAGS]
    return F.sha1(F.lower(F.concat_ws("|", "source_url", "target_url", "anchor", *flags)))


def vendor_a_facts(links: DataFrame) -> DataFrame:
    """One row per competitor and referring domain."""
    return first_wins(links, ["competitor_domain", "ref_domain"])


#: What the fingerprint is read from.
FINGERPRINT_COLUMNS = ("source_url", "target_url", "anchor", *FINGERPRINT_FLAGS)


def _needed(rows: DataFrame, columns: Sequence[str] | None, *keys: str) -> DataFrame:
    """The named columns (all without names) and those that the key and the order of arrival are read from."""
    return rows.select(*dict.fromkeys([*keys, *columns, "src_ord"])) if columns else rows


def vendor_b_facts(links: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per competitor and link fingerprint; ``columns`` are those of the links that the caller reads.

    The rows are stored without the fingerprint, which does not compress; where it is exchanged it is 20 bytes and not 40 digits.
    """
    rows = _needed(links, columns, "competitor_domain", *FINGERPRINT_COLUMNS)
    kept = first_wins_apart(
        rows, ["competitor_domain", "link_fingerprint"], derived={"link_fingerprint": F.unhex(fingerprint())}
    )
    return kept.withColumn("link_fingerprint", F.lower(F.hex("link_fingerprint")))


def keyword_facts(keywords: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per competitor, keyword and country; ``columns`` are those that the caller reads."""
    key = ["competitor_domain", "keyword", "country"]
    return first_wins_apart(_needed(keywords, columns, *key), key)


def page_facts(pages: DataFrame) -> DataFrame:
    return first_wins(pages, ["competitor_domain", "page_url"])


def registrable_domains(rows: DataFrame, host: str, suffixes: DataFrame, name: str = "registrable_domain") -> DataFrame:
    """Add the domain one label below the public suffix of the host; without a match the host itself.

    ``suffixes`` has one column ``suffix`` of rules: ``co.uk``, with a wildcard for one label ``*.ck``, or an exception to one
    ``!www.ck``, whose own suffix is what follows its first label. An exception counts before all others, else the longest
    suffix. Distinct hosts are cut into their endings and joined with the rules, so the work grows with the number of hosts and
    neither side has to fit into memory.
    """
    c = F.col
    rule = c("suffix")
    kind = F.when(rule.startswith("!"), 1).when(rule.startswith("*."), -1).otherwise(0)
    rules = suffixes.select(kind.alias("shift"), F.regexp_replace(rule, r"^(!|\*\.)", "").alias("suffix")).distinct()
    labels = F.split(c("_host"), r"\.")
    hosts = rows.select(c(host).alias("_host")).filter(c("_host") != "").distinct()
    endings = hosts.select(
        "_host", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("at")
    ).select("_host", "at", F.array_join(F.slice("labels", c("at"), F.size("labels")), ".").alias("suffix"))
    # Where the suffix of each matching rule begins.
    begins = endings.join(rules, "suffix").select("_host", "shift", (c("at") + c("shift")).alias("at")).filter(c("at") > 0)
    best = F.coalesce(F.min(F.when(c("shift") == 1, c("at"))), F.min("at"))
    longest = (
        begins.groupBy("_host")
        .agg(best.alias("at"))
        .filter(c("at") > 1)
        .select("_host", F.array_join(F.slice(labels, c("at") - 1, F.size(labels)), ".").alias("_found"))
    )
    return (
        rows.join(longest, c(host) == c("_host"), "left")
        .withColumn(name, F.coalesce("_found", host))
        .drop("_host", "_found")
    )
