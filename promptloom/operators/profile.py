"""Corpus profiles: word statistics, coverage, lengths and text metrics of any text table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from promptloom.functions import text as T
from promptloom.operators.sampling import sample_per_group
from promptloom.sources import schemas as S

# Words that carry no content (lexical density leaves them out).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is",
    "it", "me", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with", "you",
)
MIN_COUNT = 5  # fixed value: words seen less often do not count as known


# ------------------------------------------------------------------ words of a corpus
def unigram_counts(df: DataFrame, column: str, min_count: int = MIN_COUNT) -> DataFrame:
    """(token, count) of lower-cased words seen at least ``min_count`` times.

    Counts combine map-side, so a word that fills a third of the corpus reaches its
    reducer as one row per task.
    """
    words = df.select(F.explode(T.words_of(F.col(column))).alias("token"))
    return words.groupBy("token").count().where(F.col("count") >= min_count)


def relative_frequencies(unigrams: DataFrame) -> DataFrame:
    """Adds each word's share of all counted words."""
    total = unigrams.agg(F.sum("count")).scalar()
    return unigrams.withColumn("frequency", F.col("count") / total)


def most_frequent(unigrams: DataFrame, n: int = 50) -> DataFrame:
    return unigrams.orderBy(F.desc("count"), "token").limit(n)


def distinct_tokens(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """(dataset, column, token): tokens of each text column, punctuation as space.

    All columns go through one scan; tokens drop duplicates per row first.
    """
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]
    )
    tokens = F.array_distinct(T.blank_words(F.lower(T.no_punctuation(F.col("text")))))
    return (
        df.select(F.col(dataset).alias("dataset"), F.inline(rows))
        .select("dataset", "column", F.explode(tokens).alias("token"))
        .distinct()
    )


def token_rates(tokens: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Background count per distinct token, 0 when unknown; ``is_rare`` below five.

    The result stays a table of rows: a vocabulary of any size never becomes one list.
    """
    rate = F.coalesce("count", F.lit(0))
    return (
        tokens.join(unigrams, "token", "left")
        .select("dataset", "column", "token", rate.alias("rate"))
        .withColumn("is_rare", F.col("rate") < MIN_COUNT)
    )


def coverage(rates: DataFrame) -> DataFrame:
    """Per dataset and column: distinct tokens and how many are rare."""
    return rates.groupBy("dataset", "column").agg(
        F.count("*").alias("num_tokens"), F.count_if("is_rare").alias("num_rare")
    )


def in_vocabulary(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words that are a token of the vocabulary (``word``, ``token``)."""
    return words.join(vocabulary, F.lower(F.col("word")) == F.col("token"), "left_semi")


# --------------------------------------------------------------------------- lengths
def token_statistics(df: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """Mean, smallest and largest token count."""
    return (
        df.withColumn("_n", F.size(tokens))
        .groupBy(*by)
        .agg(
            F.count("*").alias("rows"),
            F.avg("_n").alias("mean_tokens"),
            F.min("_n").alias("min_tokens"),
            F.max("_n").alias("max_tokens"),
        )
    )


def longest_texts(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Longest text per column, in words and characters."""
    parts = []
    for c in columns:
        parts += [
            F.max(F.size(T.blank_words(F.col(c)))).alias(f"{c}_words"),
            F.max(F.length(c)).alias(f"{c}_chars"),
        ]
    return df.groupBy(*by).agg(*parts)


def length_buckets(df: DataFrame, length: Column, at_least: int) -> DataFrame:
    """Token lengths that at least ``at_least`` rows share, with their counts."""
    counts = df.groupBy(length.alias("token_length")).count()
    return counts.where(F.col("count") >= at_least)


def common_lengths(df: DataFrame, length: Column, n: int = 3) -> DataFrame:
    """The ``n`` most common token lengths (the longer first among equals)."""
    counts = df.groupBy(length.alias("token_length")).count()
    return counts.orderBy(F.desc("count"), F.desc("token_length")).limit(n)


def rows_of_lengths(df: DataFrame, length: Column, lengths: DataFrame) -> DataFrame:
    """Rows whose token length is among the given ones."""
    return df.withColumn("token_length", length).join(lengths, "token_length", "left_semi")


# ------------------------------------------------------------------- nested field lists
def field_names(flat: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Distinct field names per dataset, from the JSON text of flat rows."""
    fields = F.from_json("table_fields", f"array<{S.FIELD}>")
    return (
        flat.select(F.col(dataset).alias("dataset"), F.explode(fields).alias("f"))
        .select("dataset", F.col("f.name").alias("name"))
        .distinct()
        .groupBy("dataset")
        .agg(F.count("*").alias("field_names"))
    )


def fields_per_table(flat: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Histogram of the number of fields per table."""
    fields = F.from_json("table_fields", f"array<{S.FIELD}>")
    return (
        flat.groupBy(F.col(dataset).alias("dataset"), F.size(fields).alias("fields"))
        .agg(F.count("*").alias("tables"))
    )


# ----------------------------------------------------------------------- text metrics
def lexical_density(words: Column) -> Column:
    """Share of words that carry content; NULL without words."""
    content = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.try_divide(F.size(content), F.size(words))


def syllables(words: Column) -> Column:
    """Vowel groups over all words, at least one per word."""
    return F.aggregate(
        words,
        F.lit(0),
        lambda n, w: n
        + F.greatest(F.size(F.regexp_extract_all(w, F.lit("([aeiouy]+)"), F.lit(1))), F.lit(1)),
    )


def readability(text: Column, words: Column) -> Column:
    """Flesch reading ease; NULL without words."""
    ends = F.size(F.regexp_extract_all(text, F.lit("([.!?]+)"), F.lit(1)))
    sentences = F.greatest(ends, F.lit(1))
    per_sentence = F.size(words) / sentences
    return F.when(
        F.size(words) > 0,
        F.lit(206.835)
        - F.lit(1.015) * per_sentence
        - F.lit(84.6) * F.try_divide(syllables(words), F.size(words)),
    )


#: Words whose background counts are broadcast, by default.
HOT_WORDS = 1000


def with_counts(rows: DataFrame, key: str, unigrams: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """Adds the background ``count`` of each ``token``, 0 when unknown.

    The ``hot_words`` most frequent words stand in nearly every text. They get their counts
    from a broadcast of that size; in the join of all other words their rows take part with
    a key of their own text, which matches nothing and spreads them evenly.
    """
    hot = unigrams.orderBy(F.desc("count"), "token").limit(hot_words)
    hot = hot.select("token", F.col("count").alias("_hot"))
    own = F.concat(F.lit("\x00"), F.col(key).cast("string"))
    marked = rows.join(F.broadcast(hot), "token", "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col("token")).otherwise(own)
    )
    return (
        marked.join(unigrams.withColumnRenamed("token", "_key"), "_key", "left")
        .withColumn("count", F.coalesce("_hot", "count", F.lit(0)))
        .drop("_hot", "_key")
    )


def text_metrics(df: DataFrame, key: str, column: str, unigrams: DataFrame) -> DataFrame:
    """(key, rarity, lexical_density, readability) per text.

    Rarity is the mean of ln((total + 1) / (count + 1)) over the words. Words count
    per text first, so the join to the background sees each word of a text once.
    """
    worded = df.select(key, column).withColumn("_words", T.words_of(F.col(column)))
    plain = worded.select(
        key,
        lexical_density(F.col("_words")).alias("lexical_density"),
        readability(F.col(column), F.col("_words")).alias("readability"),
    )
    total = unigrams.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    counted = (
        worded.select(key, F.explode("_words").alias("token"))
        .groupBy(key, "token")
        .agg(F.count("*").alias("n"))
    )
    rarity = (
        with_counts(counted, key, unigrams)
        .withColumn("_total", total)
        .withColumn("_rarity", F.log((F.col("_total") + 1) / (F.col("count") + 1)))
        .groupBy(key)
        .agg((F.sum(F.col("_rarity") * F.col("n")) / F.sum("n")).alias("rarity"))
    )
    return plain.join(rarity, key, "left")


def metrics_per_dataset(
    df: DataFrame, dataset: str, key: str, column: str, unigrams: DataFrame, n: int = 100, seed: int = 7
) -> DataFrame:
    """Mean metrics per dataset on a sample of ``n`` texts each (the feature's own sample)."""
    sample = sample_per_group(df, dataset, key, n, seed)
    return (
        sample.select(dataset, key)
        .join(text_metrics(sample, key, column, unigrams), key)
        .groupBy(dataset)
        .agg(
            F.count("*").alias("texts"),
            F.avg("rarity").alias("rarity"),
            F.avg("lexical_density").alias("lexical_density"),
            F.avg("readability").alias("readability"),
        )
    )


def word_share(df: DataFrame, column: str, word: str) -> DataFrame:
    """Rows that contain a word, and their share."""
    has = F.contains(F.col(column), F.lit(word))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(has).alias("with_word"),
        F.coalesce(F.avg(has.cast("int")), F.lit(0.0)).alias("share"),
    )
