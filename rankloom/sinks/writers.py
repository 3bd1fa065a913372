"""Writers: every output is a folder that the tasks write in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header of the action-queue CSV (fixed values).
QUEUE_CSV = {
    "Priority": "priority",
    "Domain": "domain",
    "Machine Score": "machine_score",
    "Machine Method": "machine_method",
    "Action Suggested": "action_suggested",
    "Classification Confidence": "confidence",
    "Classification Evidence": "evidence",
    "Alpha": "alpha",
    "Competitors": "competitors",
    "Backlinks": "backlinks",
    "Live Backlinks": "live_backlinks",
    "Source Pages": "source_pages",
    "Target Pages": "target_pages",
    "Domain Authority Score": "domain_authority_score",
    "Max Page AS": "max_page_as",
    "Avg Page AS": "avg_page_as",
    "Organic Traffic": "organic_traffic",
    "Monthly Visits": "monthly_visits",
    "Organic Keywords": "organic_keywords",
    "Traffic Status": "traffic_status",
    "Follow Rate": "follow_rate",
    "Sitewide Rate": "sitewide_rate",
    "Sponsored Rate": "sponsored_rate",
    "UGC Rate": "ugc_rate",
    "Earliest First Seen": "earliest_first_seen",
    "Latest Last Seen": "latest_last_seen",
    "Sample Links": "sample_links",
}


def write_facts(facts: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Store de-duplicated facts; ``by`` lays them out by competitor for partition pruning."""
    writer = facts.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_payload(rows: DataFrame, path: str) -> None:
    """Payload rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def _write_csv(rows: DataFrame, path: str) -> None:
    """CSV with every value quoted as it is: by default the writer would trim blanks and line ends."""
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_action_queue(queue: DataFrame, path: str) -> None:
    _write_csv(queue.select(*[F.col(column).alias(title) for title, column in QUEUE_CSV.items()]), path)


def write_batches(batches: DataFrame, path: str) -> None:
    """The open domains in queue order with their batch: one master table, cut into files along the order.

    A batch is the rows with its ``batch_no``; they stand together, in the order in which they are to be worked on.
    """
    ordered = batches.select("row_no", "batch_no", "domain").repartitionByRange("row_no").sortWithinPartitions("row_no")
    _write_csv(ordered, path)


def _apart(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """``names`` as column titles: one that differs only in case from an earlier title gets a number."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        title, n = name, 2
        while title.lower() in seen:
            title, n = f"{name} ({n})", n + 1
        seen.add(title.lower())
        out.append(title)
    return out


def with_raw_columns(rows: DataFrame, headers: Sequence[str], lead: Sequence[str | Column], raw: str = "raw_json") -> DataFrame:
    """Derived columns followed by every original header; what a row does not have is empty."""
    fields = F.from_json(F.col(raw), "map<string,string>")
    listed = rows.select(*lead, fields.alias("_fields"))
    derived = [c for c in listed.columns if c != "_fields"]
    titles = zip(headers, _apart(headers, derived), strict=True)
    return listed.select(*derived, *[F.coalesce(F.element_at("_fields", F.lit(h)), F.lit("")).alias(t) for h, t in titles])


def write_details(rows: DataFrame, path: str) -> None:
    _write_csv(rows, path)


def write_page_metrics(directories: DataFrame, traffic_pages: DataFrame, path: str) -> None:
    """Directory summary and the list of pages with traffic."""
    _write_csv(directories, f"{path}/directories")
    _write_csv(traffic_pages, f"{path}/pages")


def write_run_summary(summary: DataFrame, path: str) -> None:
    """The one-row summary of a run as JSON."""
    c = F.col
    summary.select(
        "event_type", "timestamp", F.struct(c("sites_analyzed"), c("total_keywords_extracted")).alias("data_summary")
    ).write.mode("overwrite").json(path)


def write_mails(mails: DataFrame, path: str) -> None:
    titles = {"domain": "Domain (域名)", "to": "To (收件邮箱)", "subject": "Subject (邮件主题)", "body": "Body (邮件正文)"}
    _write_csv(mails.select(*[F.col(c).alias(t) for c, t in titles.items()]), path)
