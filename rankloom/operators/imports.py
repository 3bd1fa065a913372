"""Import checks: who an export belongs to and what became of its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.functions.numbers import ratio
from rankloom.functions.text import bind, single
from rankloom.functions.urls import canonical_url, hostname


def _modal(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    c = F.col
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    filled = c(value) != ""
    best = F.min(F.when(filled, F.struct((-c("n")).alias("minus_n"), c("first"), c(value).alias("value"))))
    return (
        counted.groupBy(group)
        .agg(F.sum(F.when(filled, c("n")).otherwise(0)).alias("n_rows"), best.alias("best"))
        .select(group, c("best.value").alias("modal_value"), (-c("best.minus_n")).alias("n_modal"), "n_rows")
        .withColumn("modal_share", ratio(c("n_modal"), c("n_rows")))
    )


def modal_value(rows: DataFrame, group: str, value: str, order: str = "src_ord") -> DataFrame:
    """Most frequent non-empty value per group with its share; of equally frequent ones the first seen."""
    return _modal(rows, group, value, order).filter(F.col("modal_value").isNotNull())


def cleaned_file_name(file_name: Column) -> Column:
    """Competitor guess from an export's file name, export words removed."""
    bare = F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))
    no_links = F.regexp_replace(bare, r"^backlinks?[-_ ]*|[-_ ]*backlinks?.*$", "")
    no_export = F.regexp_replace(no_links, r"[-_ ]*export.*$|[-_ ]*semrush.*$", "")
    return F.coalesce(F.nullif(F.btrim(no_export, F.lit("-_ .")), F.lit("")), F.lit("unknown-competitor"))


def competitor_of_files(rows: DataFrame, target: str = "target_url", least_share: float = 0.5) -> DataFrame:
    """Competitor of every file: the host most target URLs point to, else the file name."""
    hosts = rows.select("src_file", "src_ord", hostname(F.col(target)).alias("host"))
    named = F.when(F.col("modal_share") >= least_share, F.col("modal_value"))
    return _modal(hosts, "src_file", "host", "src_ord").select(
        "src_file", F.coalesce(named, cleaned_file_name(F.col("src_file"))).alias("competitor_domain")
    )


def judged(rows: DataFrame, source: Column) -> DataFrame:
    """Add ``reject_reason`` (NULL: accepted) and ``rejected``: a link needs a source URL, and that URL a host."""

    def reason(url: Column) -> Column:
        return F.when(url == "", "no source URL").when(hostname(url) == "", "no host in the source URL")

    return rows.select("*", single(bind(canonical_url(source), reason)).alias("reject_reason")).withColumn("rejected", F.col("reject_reason").isNotNull())


def rejects(rows: DataFrame, source: str) -> DataFrame:
    """Rejected rows per file, reason and text of the source; ``rows`` come from :func:`judged`."""
    found = rows.filter("rejected").groupBy("src_file", F.col("reject_reason").alias("reason"), F.col(source).alias("written"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"))


def audit(
    rows: DataFrame,
    kept: DataFrame,
    headers: Mapping[str, Sequence[str]] | None = None,
    recommended: Sequence[str] = rules.LINK_EXPORT_RECOMMENDED,
) -> DataFrame:
    """Rows read, rejected, inserted and duplicate per file, with the optional columns it lacks.

    ``rows`` carries ``src_file`` and the flag ``rejected``; ``kept`` holds the facts that were stored.
    """
    read = rows.groupBy("src_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("rejected").cast("bigint").alias("n_rejected")
    )
    stored = kept.groupBy("src_file").agg(F.count(F.lit(1)).alias("n_inserted"))
    result = (
        read.join(stored, "src_file", "left")
        .withColumn("n_inserted", F.coalesce("n_inserted", F.lit(0)).cast("bigint"))
        .withColumn("n_duplicates", F.col("n_rows") - F.col("n_rejected") - F.col("n_inserted"))
    )
    notes = [
        F.when(F.col("n_rejected") > 0, F.format_string("rejected %d", F.col("n_rejected"))),
        F.when(F.col("n_duplicates") > 0, F.format_string("duplicates %d", F.col("n_duplicates"))),
    ]
    for name, columns in (headers or {}).items():
        missing = sorted(set(recommended) - {h.lower() for h in columns})
        if missing:
            notes.append(F.when(F.col("src_file") == name, F.lit("missing columns: " + ", ".join(missing))))
    return result.withColumn("note", F.concat_ws("; ", *notes)).withColumn(
        "note", F.when(F.col("note") == "", "OK").otherwise(F.col("note"))
    )
