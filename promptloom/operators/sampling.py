"""Seeded samples, shuffles, splits and repeats. All orders come from hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptloom.functions.draws import chance, digest, draw

def quick_rows(df: DataFrame, order_col: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows by a key (a distributed top-n, no full sort)."""
    return df.orderBy(order_col).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 7, place: str | None = None) -> DataFrame:
    """All rows in an order drawn from the seed (a range-partitioned sort); with ``place`` the rows
    in no order, but each with its place in it, from 0.

    Places need no global sort: the first four hex digits of the digest name a bucket, the rows
    of a bucket are ranked in a task, and move by the sizes of the buckets before (65536 at most,
    so one task can add them up and a broadcast can carry them).
    """
    hashed = df.withColumn("_h", digest(seed, key))
    if place is None:
        return hashed.orderBy("_h", key).drop("_h")
    dealt = hashed.withColumn("_bucket", F.substring("_h", 1, 4))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_moved")
    )
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    return dealt.withColumn("_own", own).join(F.broadcast(moved), "_bucket").select(
        *df.columns, (F.col("_moved") + F.col("_own") - 1).alias(place)
    )


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows without replacement: those with the smallest digests."""
    return df.withColumn("_h", digest(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows per group. Spark keeps the best ``n`` per group and task before the
    shuffle (window group limit), so a large group sends ``n`` rows per task."""
    order = Window.partitionBy(group).orderBy("_h", key)
    return (
        df.withColumn("_h", digest(seed, F.col(key)))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= n)
        .drop("_h", "_rank")
    )


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered in ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def split_by_hash(
    df: DataFrame, key: str, seed: int = 7, test: float = 0.1, validation: float = 0.15
) -> DataFrame:
    """``split`` column by independent draws: no shuffle, sizes right on average."""
    k = F.col(key)
    return df.withColumn(
        "split",
        F.when(chance(test, seed, k, "split_test"), F.lit("test"))
        .when(chance(validation, seed, k, "split_validation"), F.lit("validation"))
        .otherwise(F.lit("train")),
    )


def split_exact(
    df: DataFrame, key: str, seed: int = 7, test: float = 0.1, validation: float = 0.15
) -> DataFrame:
    """``split`` column with exact sizes: ceil(test·n), then ceil(validation·rest).

    Rows rank by a hashed 32-bit number. A histogram of its upper half places whole
    buckets without sorting; only the two buckets a cut falls into are ranked row by
    row, so no task ever sees more than about n / 65536 rows for ranking.
    """
    keyed = df.withColumn("_u", draw(seed, F.col(key), "split")).withColumn(
        "_bucket", F.shiftright("_u", 16).cast("int")
    )
    # At most 65536 rows, so one task can add them up and a broadcast can carry them.
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    first_cut = F.ceil(F.col("_n") * F.lit(test))
    second_cut = first_cut + F.ceil((F.col("_n") - first_cut) * F.lit(validation))
    starts = (
        sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_n", F.sum("_size").over(whole))
        .withColumns({"_cut1": first_cut, "_cut2": second_cut})
        .withColumn(
            "_on_cut",
            F.col("_cut1").between(F.col("_start") + 1, F.col("_start") + F.col("_size") - 1)
            | F.col("_cut2").between(F.col("_start") + 1, F.col("_start") + F.col("_size") - 1),
        )
    )

    def named(rank: Column) -> Column:
        return (
            F.when(rank < F.col("_cut1"), F.lit("test"))
            .when(rank < F.col("_cut2"), F.lit("validation"))
            .otherwise(F.lit("train"))
        )

    placed = keyed.join(F.broadcast(starts), "_bucket")
    clear = placed.where(~F.col("_on_cut")).withColumn("split", named(F.col("_start")))
    order = Window.partitionBy("_bucket").orderBy("_u", key)
    ranked = placed.where("_on_cut").withColumn(
        "split", named(F.col("_start") + F.row_number().over(order) - 1)
    )
    return clear.unionByName(ranked).select(*df.columns, "split")
