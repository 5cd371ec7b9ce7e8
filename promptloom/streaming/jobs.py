"""The map-only jobs over streams: scoring and rewriting hold no state, so the same
functions take a streaming DataFrame and each input row gives its output once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from promptloom.operators.rewrite import rewrite_prompts
from promptloom.operators.score import score_rows
from promptloom.session import shared_folder
from promptloom.sources import schemas as S

SCORE_INPUT = (
    f"item_id bigint, source_csn int, table_name {S.TABLE}, select array<{S.SELECT}>, "
    f"order_by array<{S.ORDER}>, sql_statement string, where array<string>, join_table {S.TABLE}, "
    "kind string, generated string"
)
PROMPT_INPUT = "item_id bigint, prompt string"


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files as a stream, at most ``per_trigger`` new files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def write_files(df: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append to Parquet files; progress is kept in the shared folder, so a restarted
    query goes on where it stopped and writes nothing twice."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{shared_folder(df.sparkSession)}/streams/{name}")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def score_stream(spark: SparkSession, source: str, target: str, name: str) -> StreamingQuery:
    """Score prediction files as they arrive."""
    scored = score_rows(files(spark, source, SCORE_INPUT))
    return write_files(
        scored.select("item_id", "kind", "earned", "possible", "score", "strict_score", "exact"),
        target,
        name,
    )


def rewrite_stream(
    spark: SparkSession, source: str, target: str, name: str, kinds=None, seed: int = 7
) -> StreamingQuery:
    """Rewrite prompt files as they arrive."""
    prompts = files(spark, source, PROMPT_INPUT)
    return write_files(
        rewrite_prompts(prompts, kinds, seed).select("item_id", "kind", "rewritten"), target, name
    )
