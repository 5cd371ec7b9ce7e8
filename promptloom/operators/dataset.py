"""The dataset build: items, splits, flat rows on disk, and a self-check."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptloom.operators.generate import generate_items, generate_sets
from promptloom.operators.sampling import split_by_hash, split_exact
from promptloom.operators.score import score_rows, self_check
from promptloom.session import discard, stored
from promptloom.sources.corpus import from_flat, read_corpus, to_flat, write_corpus


SPLITS = ("train", "validation", "test")  # fixed values
# Generators by name (ids → items) and scorers by name (rows with predictions → scores).
GENERATORS = {f"cs{csn}": partial(generate_items, csn=csn) for csn in range(1, 6)}
GENERATORS["cs1-3"] = partial(generate_sets, csns=(1, 2, 3))  # the sets with points, in one pass
SCORERS = {"points": score_rows}


def checked_set(ids: DataFrame, generator: str, scorer: str = "points", **options) -> DataFrame:
    """Self-check of a registered generator with a registered scorer."""
    return self_check(GENERATORS[generator](ids, **options), SCORERS[scorer])


def build_dataset(
    spark: SparkSession,
    path: str,
    dataset: str,
    rows: int = 100_000,
    csn: int = 1,
    *,
    seed: int = 7,
    use_synonyms: bool = False,
    exact_split: bool = True,
    generator=generate_items,
    scorer=score_rows,
) -> DataFrame:
    """Generate, split and store a dataset; returns the self-check of its train split.

    ``generator(ids, csn, seed, ...)`` and ``scorer(rows)`` are plain functions over
    DataFrames, so others can take their place. The check reads the stored rows.
    """
    ids = spark.range(rows).withColumnRenamed("id", "item_id")

    def flat(some: DataFrame) -> DataFrame:
        items = generator(
            some, csn, seed, total=rows,
            use_synonyms_table=use_synonyms, use_synonyms_field=use_synonyms,
        )
        return to_flat(items, "item_id", "source_csn")

    if exact_split:
        # The split depends on the id alone: ids are split, then every item is made once.
        placed = stored(split_exact(ids, "item_id", seed))
        for name in SPLITS:
            own = placed.where(F.col("split") == name).select("item_id")
            write_corpus(flat(own).withColumn("split", F.lit(name)), path, dataset)
        discard(placed)
    else:
        write_corpus(split_by_hash(flat(ids), "item_id", seed), path, dataset)
    train = read_corpus(spark, path, dataset, "train")
    back = from_flat(train, "item_id", "source_csn").withColumns(
        {
            "where": F.lit(None).cast("array<string>"),
            "join_table": F.lit(None).cast("struct<name:string,synonym:string,use_synonym:boolean>"),
        }
    )
    return self_check(back, scorer)
