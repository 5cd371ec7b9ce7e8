"""Rewrite jobs: prompts in, one row per prompt and rewrite out; and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from promptloom.functions import rewriting as R, similarity as M, text as T
from promptloom.functions.vectors import cosine
from promptloom.sources.vocabulary import PAIRS


def rewrite_prompts(
    prompts: DataFrame, kinds: tuple[str, ...] | None = None, seed: int = 7,
    words=PAIRS.random_words,
) -> DataFrame:
    """One row per prompt and rewrite kind; ``rewritten`` is NULL where a swap failed.

    Input columns ``item_id`` and ``prompt``. Map-only: the kinds are one array that is
    exploded in place.
    """
    table = R.rewrites(seed, F.col("item_id"), words)
    unknown = set(kinds or ()) - set(table)
    if unknown:
        raise ValueError(f"unknown rewrite: {sorted(unknown)}")
    rows = [
        F.struct(F.lit(k).alias("kind"), table[k](F.col("prompt")).alias("rewritten"))
        for k in (kinds or tuple(table))
    ]
    return prompts.select("item_id", "prompt", F.inline(F.array(*rows)))


def sweep_prompts(prompts: DataFrame, sweep: str) -> DataFrame:
    """One row per prompt and word of a sweep; ``show me`` reads as ``select`` first."""
    old, words = R.SWEEPS[sweep]
    base = F.replace(F.col("prompt"), F.lit("show me"), F.lit("select"))
    return (
        prompts.withColumn("_base", base)
        .withColumn("word", F.explode(F.array(*[F.lit(w) for w in words])))
        .select(
            "item_id",
            F.lit(sweep).alias("sweep"),
            "word",
            R.replace_words(F.col("_base"), old, F.col("word")).alias("rewritten"),
        )
    )


def with_parts(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumns(R.prompt_parts(F.col(column)))


def compare_sql(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The three similarity scores of two SQL texts; a NULL text gives 0."""
    x, y = F.col(a), F.col(b)

    def or_zero(score: Column) -> Column:
        return F.coalesce(score, F.lit(0.0))

    return pairs.withColumns(
        {
            "five_point": or_zero(M.five_point_similarity(x, y)),
            "eight_point": or_zero(M.eight_point_similarity(x, y)),
            "clause_points": or_zero(M.clause_similarity(x, y)),
        }
    )


def similarity_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Mean similarity per group, successes and their share; a NULL similarity failed."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity"),
        F.count("similarity").alias("successes"),
        (F.count("similarity") / F.count("*")).alias("success_rate"),
    )


def word_vectors(token_vectors: DataFrame) -> DataFrame:
    """Mean-pooled vector per word from rows (word, vector).

    Averages per dimension aggregate map-side, so a word with very many rows is no
    hot spot; only (word, dimension) sums are shuffled.
    """
    return (
        token_vectors.select("word", F.posexplode("vector").alias("dim", "x"))
        .groupBy("word", "dim")
        .agg(F.avg("x").alias("x"))
        .groupBy("word")
        .agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
        .select("word", F.col("v")["x"].alias("vector"))
    )


SALTS = 64


def output_similarity(outputs: DataFrame, vectors: DataFrame, salts: int = SALTS) -> DataFrame:
    """Similarity of two outputs word by word: 1 for equal words, else the cosine of their
    vectors; the shorter output sets the length; nothing to compare gives 0.

    ``outputs``: item_id, a, b. ``vectors``: word, vector. Cosines are computed once per
    distinct pair of different words. A pair that very many items hold is dealt out over
    ``salts`` keys, each with a copy of the pair's cosine.
    """
    zipped = F.arrays_zip(
        F.slice("_a", F.lit(1), F.least(F.size("_a"), F.size("_b"))).alias("x"),
        F.slice("_b", F.lit(1), F.least(F.size("_a"), F.size("_b"))).alias("y"),
    )
    words = outputs.select(
        "item_id", T.blank_words(F.col("a")).alias("_a"), T.blank_words(F.col("b")).alias("_b")
    ).select("item_id", F.explode_outer(zipped).alias("w"))
    counted = words.groupBy("item_id", F.col("w.x").alias("x"), F.col("w.y").alias("y")).agg(
        F.count("*").alias("n")
    )
    other = counted.where("x <> y")
    # A frequent word stands in many pairs: its vector is copied to every salt, too.
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(salts)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    similar = (
        other.select("x", "y")
        .distinct()
        .select("x", "y", salt)
        .join(vectors.select(F.col("word").alias("x"), F.col("vector").alias("vx"), every), ["x", "salt"])
        .join(vectors.select(F.col("word").alias("y"), F.col("vector").alias("vy"), every), ["y", "salt"])
        .select("x", "y", cosine(F.col("vx"), F.col("vy")).alias("sim"))
    )
    # Equal words, often the bulk, stay out of the join.
    own = F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int").alias("salt")
    scored = (
        other.select("item_id", "x", "y", "n", own)
        .join(similar.select("x", "y", "sim", every), ["x", "y", "salt"], "left")
        .select("item_id", "n", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    )
    equal = counted.where("x = y").select("item_id", "n", F.lit(1.0).alias("sim"))
    nothing = counted.where("x is null").select("item_id", F.lit(0).alias("n"), F.lit(0.0).alias("sim"))
    return (
        scored.unionByName(equal)
        .unionByName(nothing)
        .groupBy("item_id")
        .agg(
            F.coalesce(
                F.try_divide(F.sum(F.col("sim") * F.col("n")), F.sum("n")), F.lit(0.0)
            ).alias("similarity")
        )
    )


def sweep_by_input_similarity(words: DataFrame, vectors: DataFrame, target: str) -> DataFrame:
    """Words with the cosine to a target word, lowest first."""
    goal = vectors.where(F.col("word") == target).select("vector").scalar()
    return (
        words.join(vectors, "word")
        .withColumn("goal", goal)
        .select("word", cosine(F.col("vector"), F.col("goal")).alias("similarity"))
        .orderBy("similarity", "word")
    )
