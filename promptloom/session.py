"""Session and checkpoint helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "promptloom", cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else each Column call asks the JVM twice
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/promptloom-shared").rstrip("/")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Stored tables of this JVM by path: weak references to what every plan that reads them holds.
_READ: dict[str, list] = {}
_JVM: list = []


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder as the driver ends."""
    place, files = _place(spark, path)
    files.deleteOnExit(place)


def _watch(df: DataFrame, path: str) -> DataFrame:
    """Keep the table at ``path`` as long as ``df``, or a DataFrame made from it, can be run."""
    files = df._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    _READ.setdefault(path, []).append(df.sparkSession._jvm.java.lang.ref.WeakReference(files))
    return df


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: cuts the lineage, survives lost
    executors. The shuffle files behind it are dropped as soon as the table is written; the table
    itself when no DataFrame reads it any more (:func:`sweep`), at the latest as the driver ends."""
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    delete_on_exit(spark, path)
    return _watch(spark.read.schema(df.schema).parquet(path), path)


def paths_of(table: DataFrame) -> set[str]:
    """Where ``stored`` has put a table; nothing for a table without files."""
    paths = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    if any("/stored-" not in path for path in paths):
        raise ValueError(f"not a stored table: {sorted(paths)}")
    return paths


def reread(table: DataFrame, schema) -> DataFrame:
    """A stored table read with another schema."""
    (own,) = paths_of(table)
    known = next(path for path in _READ if path.rsplit("/", 1)[1] == own.rsplit("/", 1)[1])
    return _watch(table.sparkSession.read.schema(schema).parquet(own), known)


def sweep(spark: SparkSession, collect: bool = False) -> int:
    """Delete the stored tables that no DataFrame reads any more, and say how many those were.

    Every call of ``stored`` does it for tables whose readers Python and the JVM have already let
    go; ``collect`` makes both collect their garbage first.
    """
    if _JVM != [spark._jvm]:  # tables of a JVM that has ended went with it
        _READ.clear()
        _JVM[:] = [spark._jvm]
    if collect:
        gc.collect()
        spark._jvm.System.gc()
    gone = [path for path, readers in _READ.items() if all(r.get() is None for r in readers)]
    for path in gone:
        place, files = _place(spark, path)
        files.delete(place, True)
        del _READ[path]
    return len(gone)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has made and that nothing reads any more."""
    for table in tables:
        for path in paths_of(table):
            place, files = _place(table.sparkSession, path)
            files.delete(place, True)
