"""Work over a total order without a task that sees a whole group.

Rows are dealt out by ranges of (group, order), so a group of any size lies in consecutive ranges.
Windows run inside a range; what must pass from one range to the next is one row per range, so it
is small (as many rows as shuffle partitions) whatever the number of rows or groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptloom.session import stored

RANGE = "_range"


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with the number of their range. They are stored, so that every pass over them, also
    after a lost executor, sees the same ranges."""
    return stored(rows.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def _group(by: Sequence[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("one"))


def _over_ranges():
    """One row per range goes into this window."""
    return Window.orderBy(RANGE)


def numbered(rows: DataFrame, order: Sequence[Column | str], place: str = "place") -> DataFrame:
    """Adds the place of each row in the whole order, from 0."""
    parts = ranged(rows, *order)
    before = _over_ranges().rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.groupBy(RANGE).agg(F.count("*").alias("_n")).select(
        RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_moved")
    )
    own = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(moved), RANGE).select(
        *rows.columns, (F.col("_moved") + F.col("_own") - 1).alias(place)
    )


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a group up to this one, in the given order."""
    parts = ranged(rows, *by, *order)
    so_far = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(RANGE, *by).agg(F.sum(value).alias("_sum")).select(RANGE, _group(by).alias("_g"), "_sum")
    # Earlier ranges of a group end with it: the sum of a range's last group may go on in the next.
    edges = sums.groupBy(RANGE).agg(F.min("_g").alias("_first"), F.max(F.struct("_g", "_sum")).alias("_last"))
    same = Window.partitionBy("_last._g").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)
    carried = edges.withColumn("_until", F.sum("_last._sum").over(same)).select(
        RANGE, "_first", F.lag("_last._g").over(_over_ranges()).alias("_before"), F.lag("_until").over(_over_ranges()).alias("_carry")
    )
    carried = carried.where(F.col("_first").eqNullSafe(F.col("_before"))).drop("_before")
    joined = parts.withColumn("_local", F.sum(value).over(so_far)).join(F.broadcast(carried), RANGE, "left")
    goes_on = F.coalesce(_group(by).eqNullSafe(F.col("_first")), F.lit(False))
    whole = F.col("_local") + F.when(goes_on, F.col("_carry")).otherwise(F.lit(0))
    return joined.select(*rows.columns, whole.alias(total))


def next_in_circle(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, following: str) -> DataFrame:
    """Adds the ``value`` of the next row of the group in the given order; the last row gets that of
    the first."""
    parts = ranged(rows, *by, *order)
    inside = Window.partitionBy(RANGE, *by).orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.struct(F.col(value).alias("v"))  # a struct tells a null value from no row
    entry = F.struct(*order, held.alias("_held"))
    starts = parts.groupBy(RANGE, *by).agg(F.min(entry).alias("_start")).select(RANGE, _group(by).alias("_g"), "_start._held")
    edges = starts.groupBy(RANGE).agg(F.min(F.struct("_g", "_held")).alias("_first"), F.max(F.struct("_g", "_held")).alias("_last"))
    near = _over_ranges()
    same = Window.partitionBy("_last._g").orderBy(RANGE)
    # The group that a range ends with may have begun in an earlier one: its first value from there.
    known = edges.withColumn("_began", F.first("_last._held").over(same))
    linked = known.select(
        RANGE,
        F.col("_first._g").alias("_first"),
        F.col("_last._g").alias("_last"),
        F.lag("_last._g").over(near).alias("_before"),
        F.lag("_began").over(near).alias("_carry"),
        F.lead("_first").over(near).alias("_after"),
    )
    linked = linked.select(
        RANGE, "_first", "_last",
        F.when(F.col("_before").eqNullSafe(F.col("_first")), F.col("_carry")).alias("_carry"),
        F.when(F.col("_after._g").eqNullSafe(F.col("_last")), F.col("_after._held")).alias("_after"),
    )
    local = parts.withColumns({"_next": F.lead(held).over(inside), "_own": F.first(held).over(whole)})
    joined = local.join(F.broadcast(linked), RANGE)
    own = _group(by)
    after = F.when(own.eqNullSafe(F.col("_last")), F.col("_after"))
    begun = F.when(own.eqNullSafe(F.col("_first")), F.col("_carry"))
    return joined.select(*rows.columns, F.coalesce("_next", after, begun, "_own")["v"].alias(following))
