"""Keep-first, top-n, shares, running sums and numbering that hold up under skewed keys.

A window is used only behind a row limit (Spark then drops rows before the shuffle) or over data that an
aggregate has already reduced to a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import store


def _as_columns(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of every group, each map task sending at most ``n`` rows per group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_as_columns(order_by)))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def first_wins(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str] = ("src_ord",)) -> DataFrame:
    """One row per key: the one that arrived first."""
    return top_per_group(df, keys, order_by, 1)


#: Bits in which repeated keys leave a mark. They are kept 64 to a row, so the table of marks has at most 1,048,576 rows whatever the
#: number of keys, which is what bounds its broadcast. With very many repeated keys other rows share their marks.
MARK_BITS = 1 << 26


def _mark(digest: Column) -> tuple[Column, Column]:
    """The row of the table of marks that a digest belongs to, and its bit there."""
    word = F.shiftright(digest.bitwiseAND(F.lit(MARK_BITS - 1).cast("bigint")), 6)
    return word, F.call_function("shiftleft", F.lit(1).cast("bigint"), digest.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def set_apart(rows: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key no other row has, and those whose key others may have.

    ``digest`` is a 64-bit hash of the key, so equal keys are always on the same side, and only the other side has to be exchanged
    with all its columns. ``rows`` are read three times: give a stored table. The counts of the digests are folded map-side, so a
    hot key is one row per task.
    """
    c = F.col
    word, bit = _mark(c(digest))
    several = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > 1)
    marks = store(several.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_marks")))
    marked = rows.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    again = F.coalesce(c("_marks").bitwiseAND(bit) != 0, F.lit(False))
    return marked.filter(~again).select(*rows.columns), marked.filter(again).select(*rows.columns)


def first_wins_apart(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column | str] = ("src_ord",),
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """:func:`first_wins` for wide rows most of whose keys occur once, such as the rows of exports.

    The rows are stored with a digest of their key, and only those whose key may occur again go through the exchange that finds
    the first one. ``derived`` are columns of the result that may be part of the key; they are read from the stored ones.
    """
    derived = dict(derived or {})
    parts = [derived.get(k, F.col(k)) for k in keys]
    rows = store(df.withColumn("_digest", F.xxhash64(*parts)))
    once, again = (part.drop("_digest").withColumns(derived) for part in set_apart(rows, "_digest"))
    return once.unionByName(first_wins(again, keys, order_by))


def highest_per_key(df: DataFrame, keys: Sequence[str], measure: str, tie: Sequence[Column | str]) -> DataFrame:
    """One row per key: the one with the highest measure."""
    return top_per_group(df, keys, [F.col(measure).desc(), *tie], 1)


def with_group_total(df: DataFrame, keys: Sequence[str], measure: str, total: str) -> DataFrame:
    """Add the sum of ``measure`` over the group to every row.

    The totals come from their own aggregate and are joined back; a window over the group would bring all
    rows of a hot group into one task. Spark broadcasts the totals when they are small enough and splits
    the hot partitions when they are not.
    """
    totals = df.groupBy(*keys).agg(F.sum(measure).alias(total))
    return df.join(totals, list(keys))


def yearly_grid(counts: DataFrame, group: str, year: str, measures: Sequence[str]) -> DataFrame:
    """Every group with every year that occurs anywhere, absent counts as 0.

    Years are four-digit texts, so a group has few of them whatever the data: its counts are folded into one
    map, and the set of all years is read as one array value instead of being joined to every group.
    """
    c = F.col
    years = counts.agg(F.array_sort(F.collect_set(year))).scalar()
    known = counts.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct(c(year), F.struct(*measures)))).alias("_known")
    )
    return known.select(group, F.explode(years).alias(year), "_known").select(
        group,
        year,
        *[F.coalesce(c("_known")[c(year)][m], F.lit(0)).cast("bigint").alias(m) for m in measures],
    )


def running_totals(yearly: DataFrame, group: str, year: str, measures: Sequence[str]) -> DataFrame:
    """Add ``cum_<measure>``: the running sum over the years of a group (one row per group and year)."""
    so_far = Window.partitionBy(group).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return yearly.withColumns({f"cum_{m}": F.sum(m).over(so_far) for m in measures})


def number_rows(df: DataFrame, order_by: Sequence[Column | str], name: str, start: int = 1) -> DataFrame:
    """Number all rows 1, 2, 3 … in the given total order without a single-task sort.

    Rows are range-partitioned and sorted in parallel, stored with their place, counted per partition
    and shifted by the count of the partitions before them. The offsets table has one row per
    partition, which is what bounds its broadcast.
    """
    order = _as_columns(order_by)
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = store(
        spread.withColumn("_part", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_part", "_pos", "_offset")
    )


def with_batches(df: DataFrame, order_by: Sequence[Column | str], size: int = 200) -> DataFrame:
    """Cut an ordered list into numbered batches of ``size`` rows."""
    numbered = number_rows(df, order_by, "row_no")
    return numbered.withColumn("batch_no", F.floor((F.col("row_no") - 1) / F.lit(size)).cast("bigint") + 1)
