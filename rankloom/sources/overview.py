"""Traffic overview: a wide export with two header rows, turned into one row per day and domain."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import BOM
from rankloom.sources.exports import file_place

FIRST_DATA_ROW = 4
METRIC = "Organic traffic"
SCOPE = "subdomains"


def traffic_columns(domains: Sequence[str | None], metrics: Sequence[str | None]) -> dict[str, int]:
    """Column index per domain; the first matching column of a domain counts."""
    labels = [(re.sub(rf"/? \({SCOPE}\)", "", d or "").strip(), SCOPE in (d or ""), (m or "").strip()) for d, m in zip(domains, metrics)]
    usable = [(name, index) for index, (name, scoped, metric) in enumerate(labels) if scoped and metric == METRIC]
    # Read from the right, so that the leftmost column of a domain is the one that stays.
    leftmost = dict(reversed(usable))
    return {name: leftmost[name] for name in dict.fromkeys(name for name, _ in usable)}


def long_traffic(wide: DataFrame, date: str, columns: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep, date, domain, traffic)`` from a wide table of texts; what is not a whole number counts as 0."""
    whole = lambda name: F.when(F.trim(name).rlike(r"^[+-]?\d+$"), F.trim(name).try_cast("bigint"))
    narrow = wide.filter(F.col(date) != "").select(
        *keep,
        F.col(date).alias("date"),
        *[F.coalesce(whole(column), F.lit(0).cast("bigint")).alias(domain) for domain, column in columns.items()],
    )
    return narrow.unpivot([*keep, "date"], [F.col(f"`{domain}`") for domain in columns], "domain", "traffic")


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(path, place, line) of all files. Files are read by lines, because blank lines count when the data rows are located."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    line = F.replace("value", F.lit(BOM), F.lit("")).alias("line")
    return spark.read.text(list(files)).select(F.col("_metadata.file_path").alias("path"), place.alias("place"), line)


def read_traffic_overviews(spark: SparkSession, files: Sequence[str], separator: str = ",") -> DataFrame:
    """All overview exports together: of several files with a day of a domain the first in ``files`` counts.

    Each has two header lines, two that are passed over, then the data. One job brings the first lines of all files to the
    driver; files with the same columns are then read as one, so jobs and plan grow with the kinds of headers only.
    """
    c = F.col
    lines = _lines(spark, files)
    along = Window.partitionBy("path").orderBy("place")
    heads: dict[str, list] = defaultdict(list)
    for row in lines.withColumn("n", F.row_number().over(along)).filter(c("n") <= FIRST_DATA_ROW + 1).orderBy("path", "n").collect():
        heads[row.path].append(row)
    number = {file_place(path): i for i, path in enumerate(files)}
    kinds: dict[tuple, list[tuple]] = defaultdict(list)
    for path, head in heads.items():
        if len(head) <= FIRST_DATA_ROW:
            continue
        domains, metrics = (next(csv.reader([row.line], delimiter=separator), []) for row in head[:2])
        columns = traffic_columns(domains, metrics)
        if columns:
            start = head[FIRST_DATA_ROW].place
            kinds[len(domains), tuple(columns.items())].append((path, number[file_place(path)], start.block, start.row))
    parts = [spark.createDataFrame([], "date string, domain string, traffic bigint, file_no int")]
    for (width, columns), found in kinds.items():
        starts = spark.createDataFrame(found, "path string, file_no int, block bigint, row bigint")
        names = [f"c{i}" for i in range(max(width, 1))]
        options = {"sep": separator, "quote": '"', "escape": '"'}
        cells = F.from_csv(c("line"), F.lit(", ".join(f"{n} string" for n in names)), options)
        data = lines.join(starts, "path").filter(c("place") >= F.struct("block", "row")).select("file_no", cells.alias("cells"))
        wanted = {domain: names[index] for domain, index in columns}
        parts.append(long_traffic(data.select("file_no", "cells.*"), names[0], wanted, ["file_no"]).select("date", "domain", "traffic", "file_no"))
    first = reduce(DataFrame.unionByName, parts).groupBy("date", "domain").agg(F.min(F.struct("file_no", "traffic")).alias("first"))
    return first.select("date", "domain", F.col("first.traffic").alias("traffic"))


def read_traffic_overview(spark: SparkSession, file: str, separator: str = ",") -> DataFrame:
    """One overview export."""
    return read_traffic_overviews(spark, [file], separator)
