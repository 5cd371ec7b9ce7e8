"""Datasets on disk: flat rows with splits, JSON documents, cached results."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from promptloom.sources import schemas as S


def to_flat(items: DataFrame, *keep: str) -> DataFrame:
    """Items as the ten flat columns; nested lists become JSON text, a NULL list stays NULL."""
    return items.select(
        *keep,
        "command_set",
        F.col("table_name.name").alias("table_name"),
        F.col("table_name.synonym").alias("table_name_synonym"),
        F.col("table_name.use_synonym").alias("table_name_use_synonym"),
        "create_statement",
        "english_prompt",
        "sql_statement",
        F.to_json("table_fields").alias("table_fields"),
        F.to_json("select").alias("select"),
        F.to_json("order_by").alias("order_by"),
    )


def from_flat(flat: DataFrame, *keep: str) -> DataFrame:
    """Flat rows as items; what flat rows do not hold is NULL."""
    flag = F.coalesce("table_name_use_synonym", F.lit(False))
    return flat.select(
        *keep,
        "command_set",
        F.struct(
            F.col("table_name").alias("name"),
            F.col("table_name_synonym").alias("synonym"),
            flag.alias("use_synonym"),
        ).alias("table_name"),
        F.from_json("table_fields", f"array<{S.FIELD}>").alias("table_fields"),
        "create_statement",
        F.from_json("select", f"array<{S.SELECT}>").alias("select"),
        F.from_json("order_by", f"array<{S.ORDER}>").alias("order_by"),
        F.lit(None).cast("array<string>").alias("order_by_phrase"),
        F.lit(None).cast("array<string>").alias("agg_phrases"),
        "english_prompt",
        "sql_statement",
    )


def write_corpus(flat: DataFrame, path: str, dataset: str) -> None:
    """Add a dataset with its splits: Parquet folders by dataset and split.

    ``flat`` has a ``split`` column. Only the partitions it holds are replaced.
    """
    (
        flat.withColumn("dataset", F.lit(dataset))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "split")
        .parquet(path)
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    dataset: str | None = None,
    split: str | None = None,
    mapper: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """A dataset or one split of it; other folders are never opened (partition pruning).

    ``mapper`` turns the rows into what the caller trains on, e.g. one text column.
    """
    df = spark.read.parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df if mapper is None else df.transform(mapper)


def write_documents(df: DataFrame, path: str) -> None:
    """Result or statistics documents, one JSON object per line."""
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


EDGE_RESULT = (
    "metadata map<string,string>, parameters map<string,string>, "
    "edges array<struct<from_edge:string,to_edge:string,score:double>>"
)
PATCHING_RESULT = "metadata map<string,string>, results array<array<array<double>>>"


def version_of(spark: SparkSession, path: str) -> list:
    """Path, time of the last change and length of a file or folder of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(place)
    return [path, status.getModificationTime(), files.getContentSummary(place).getLength()]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, built: str, path: str) -> bool:
    """Rename a finished folder to its place, in one step; False if another one stands there."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context = fs.FileContext.getFileContext(jvm.java.net.URI.create(_files(spark, path)[1].getUri().toString()))
        context.rename(fs.Path(built), fs.Path(path), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName() or _files(spark, path)[1].exists(fs.Path(path)):
            return False
        raise
    return True


def cached_result(
    spark: SparkSession, folder: str, name: str, arguments: dict, build: Callable[[], DataFrame],
    inputs: tuple[str, ...] = (),
) -> DataFrame:
    """The stored result of ``name`` with these arguments, built and stored when missing.

    The folder must be shared by all executors; the key is a hash of the arguments and of
    the versions of the ``inputs`` (paths), so changed inputs are computed anew. A result is
    built beside its place and renamed to it when it is whole: readers never see a part of one,
    and of several builders at the same time the first one's result stands, the others use it.
    Using a result renews its age (see :func:`evict`).
    """
    versions = [version_of(spark, path) for path in inputs]
    text = json.dumps([name, arguments, versions], sort_keys=True, default=str)
    path = f"{folder}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    place, files = _files(spark, path)
    if not files.exists(place):
        building = f"{folder}/_building-{uuid.uuid4().hex}"
        build().write.parquet(building)
        if not _publish(spark, building, path):
            files.delete(_files(spark, building)[0], True)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    files.setTimes(place, now, -1)
    return spark.read.parquet(path)


def evict(spark: SparkSession, folder: str, seconds: float) -> list[str]:
    """Delete the cached results, and builds left by lost drivers, that weren't used for so long;
    gives their names. Choose more than the longest job takes: a plan made before reads its files
    later."""
    place, files = _files(spark, folder)
    if not files.exists(place):
        return []
    oldest = spark._jvm.java.lang.System.currentTimeMillis() - seconds * 1000
    gone = [s.getPath() for s in files.listStatus(place) if s.isDirectory() and s.getModificationTime() < oldest]
    for path in gone:
        files.delete(path, True)
    return sorted(path.getName() for path in gone)


# -------------------------------------------------------------------- bucketed tables
def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table by buckets of its key, sorted in each: tables with as many buckets of the same
    key join without a shuffle or sort of either, however often. Gives the stored table."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int, schema: str) -> DataFrame:
    """A table of :func:`write_bucketed`, also one of an earlier session; ``schema`` as DDL."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
