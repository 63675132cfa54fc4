"""Row numbers and running sums that stay distributed inside one group.

A plain window sends a whole group to one task, which fails when one key holds a large part
of the table. Groups are measured first; only when the largest exceeds ``group_limit`` are
the rows range-partitioned on (keys, order), so that a group spans many tasks, each task
counts its own part, and the parts are offset by the totals of the parts before them. There
are at most as many parts as partitions, so the window over them is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflot.session import partitions, pinned

GROUP_LIMIT = 1_000_000
_PART = "__part"
_BEFORE = "__before"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group (one small aggregate; 0 over no rows)."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def _split_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(partitions(df.sparkSession), *keys, *order)
    return pinned(ranged.withColumn(_PART, F.spark_partition_id()))


def _with_offsets(split: DataFrame, keys, order, value: Column, out: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy(*keys, _PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        split.groupBy(*keys, _PART)
        .agg(F.sum(value).alias("__sum"))
        .select(*keys, _PART, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(_BEFORE))
    )
    return (
        split.withColumn(out, F.sum(value).over(within))
        .join(offsets, [*keys, _PART])
        .withColumn(out, F.col(out) + F.col(_BEFORE))
        .drop(_PART, _BEFORE)
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column | str,
    out: str,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows up to this one.

    ``keys`` must not be NULL and ``order`` must be unique within a group.
    """
    value = F.col(value) if isinstance(value, str) else value
    if keys and largest_group(df, keys) <= group_limit:
        upto = (
            Window.partitionBy(*keys)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.withColumn(out, F.sum(value).over(upto))
    if not keys:
        constant = df.withColumn("__all", F.lit(0))
        split = _split_ordered(constant, [], order)
        return _with_offsets(split, ["__all"], order, value, out).drop("__all")
    return _with_offsets(_split_ordered(df, keys, order), keys, order, value, out)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``out``: 1, 2, 3 … within each group; over the whole table without ``keys``."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, group_limit)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group as an aggregate, so that it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    ordered = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(ordered).alias("__first")).select(
        *keys, *[F.col(f"__first.{c}").alias(c) for c in [*order, *rest]]
    ).select(*df.columns)
