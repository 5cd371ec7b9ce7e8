"""Reading tables, and spreading small files over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt out evenly over ``partitions``, by default as many as a shuffle has.

    For jobs that do much work for each narrow row (generation from ids): the files of such
    a table say nothing about the work in it.
    """
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
