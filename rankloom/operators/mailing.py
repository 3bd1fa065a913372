"""Mail merge over a prospect list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import company_name, fill_template, strip


def mail_merge(prospects: DataFrame, subject: str, body: str, domain: str = "domain", email: str = "email") -> DataFrame:
    """One mail per prospect with a domain; a missing address stays empty for later completion."""
    c = F.col
    address = F.when(strip(c(email)) == "", "").otherwise(F.coalesce(c(email), F.lit("")))
    return prospects.filter(c(domain).isNotNull()).select(
        c(domain).alias("domain"),
        address.alias("to"),
        F.lit(subject).alias("subject"),
        fill_template(body, company_name(c(domain))).alias("body"),
    )
