"""Connected components of a table of links, by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptloom.session import discard, stored


def _large_stars(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    tied = both.where("b > a").join(least, F.col("a") == F.col("node"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
    tied = links.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("node").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(own).where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of a link (a, b), a > b, is connected to.

    Rounds of joins and minima until nothing changes, each written to the shared folder; a node with
    very many links is a skewed join side, never a list. Without links the result is empty.
    """
    now = stored(links)
    state = _state(now)
    while state[0]:
        after = stored(_small_stars(_large_stars(now)))
        later = _state(after)
        if later == state:
            discard(after)
            break
        discard(now)
        now, state = after, later
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
