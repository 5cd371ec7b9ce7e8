"""URL filter: rules for hosts and paths, and boosted trees on lexical features for all other URLs.

The trees learn from labelled URLs; here the rules label those they decide. Everything runs as
column expressions and MLlib stages. The statistics of host endings count all labelled rows; only
the trees are fitted on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from promptloom.session import stored

# The rules, as (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: Different labelled URLs that the trees learn from: those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Host endings with statistics that are broadcast; more are joined in so many salted copies.
BROADCAST_ENDINGS, SALTS = 100_000, 16
#: Parts of the labelled URLs; the rate of an ending that a tree learns from leaves out the row's own part.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy",
    "parameters", "query_length", "has_fragment", "is_secure", "longest_label", "vowel_ratio", "ending_rate",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the URL (of equal ones the first as text), else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules=RULES) -> Column:
    found = F.lit(None).cast("string")
    for verdict, text in rules:
        found = F.when(rule == text, F.lit(verdict)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character."""
    total = F.greatest(F.length(text), F.lit(1))
    parts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (total - F.length(F.replace(text, c, F.lit("")))) / total,
    )
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def _ending(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features (but for ``ending_rate``) to url, host and path; null counts as empty."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    asked = F.regexp_extract(url, "\\?([^#]*)", 1)
    total = F.greatest(F.length(url), F.lit(1))
    values = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        "host_labels": F.size(F.split(host, "\\.")),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / total,
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "entropy": entropy(url),
        "parameters": F.size(F.filter(F.split(asked, "&"), lambda p: p != "")),
        "query_length": F.length(asked),
        "has_fragment": F.instr(url, "#") > 0,
        "is_secure": url.startswith("https:"),
        "longest_label": F.array_max(F.transform(F.split(host, "\\."), F.length)),
        "vowel_ratio": F.length(F.regexp_replace(host, "[^aeiou]", "")) / F.greatest(F.length(host), F.lit(1)),
    }
    return urls.withColumns({k: v.cast("double") for k, v in values.items()})


@dataclass
class UrlModel:
    """``trees`` is None if the labels were of one kind; then ``constant`` is the probability.
    ``endings``: ending, ending_rate of every labelled host ending; others get ``constant``."""

    trees: object
    endings: DataFrame | None
    constant: float

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``block_score``, the probability that a URL is to be blocked."""
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(self.constant))
        ready = _assembled(lexical(urls), self.endings, self.constant)
        scored = self.trees.transform(ready)
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("block_score"))


def _fold():
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _out_of_fold(sample: DataFrame, counts: DataFrame, rate: float) -> DataFrame:
    """The sample with the rate of each row's ending over all rows but those of its own fold, so that
    no row's label is in its features. ``counts``: ending, fold, b, n."""
    whole = counts.groupBy("ending").agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
    others = counts.join(whole, "ending").select(
        "ending", "fold", ((F.col("all_b") - F.col("b") + 5 * rate) / (F.col("all_n") - F.col("n") + 5)).alias("ending_rate")
    )
    rows = sample.withColumns({"ending": _ending(F.col("host")), "fold": _fold()}).join(others, ["ending", "fold"], "left")
    ready = rows.withColumn("ending_rate", F.coalesce("ending_rate", F.lit(rate))).drop("ending", "fold")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)


def _assembled(rows: DataFrame, endings: DataFrame, rate: float) -> DataFrame:
    ending = _ending(F.col("host"))
    if endings.count() <= BROADCAST_ENDINGS:
        rows = rows.withColumn("ending", ending).join(F.broadcast(endings), "ending", "left")
    else:  # a host of many URLs is dealt out
        copies = endings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumns({"ending": ending, "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
        rows = rows.join(copies, ["ending", "salt"], "left").drop("salt")
    rows = rows.withColumn("ending_rate", F.coalesce("ending_rate", F.lit(rate))).drop("ending")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 4) -> UrlModel:
    """Boosted trees from (url, host, path, label), label 1: block. They are fitted on at most
    ``rows`` different URLs, those with the smallest hashes; the statistics of host endings are part
    of the model and count all labelled rows."""
    labelled = labelled.where("label IS NOT NULL")
    counts = labelled.groupBy(_ending(F.col("host")).alias("ending"), _fold().alias("fold"))
    counts = stored(counts.agg(F.sum("label").alias("b"), F.count("*").alias("n")))
    ends = counts.groupBy("ending").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    sums = ends.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    rate = sums["b"] / sums["n"] if sums["n"] else 0.0
    if rate in (0.0, 1.0):
        return UrlModel(None, None, rate)
    few = labelled.select("url", "label").distinct().orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    sample = lexical(few.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})).cache()
    if sample.select("label").distinct().count() < 2:
        sample.unpersist()
        return UrlModel(None, None, rate)
    endings = ends.select("ending", ((F.col("b") + 5 * rate) / (F.col("n") + 5)).alias("ending_rate"))
    ready = _out_of_fold(sample, counts, rate)
    fitted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7).fit(ready)
    sample.unpersist()
    return UrlModel(fitted, endings, rate)


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row of ``pages``.

    The verdict is the rule's, else the trees' (block from ``threshold`` on). URLs that a rule
    decides are the labelled ones. A null URL or one without ``://`` has an empty host and path, no
    rule, and is judged by the trees like any other. Without any decided URL all others are
    allowed. Repeated rows give repeated results; other columns aren't read.
    """
    urls = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = urls.where("rule IS NOT NULL")
    label = (rule_verdict(F.col("rule"), rules) == "block").cast("int")
    scored = learn(decided.select("url", "host", "path", label.alias("label"))).score(urls)
    by_trees = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), by_trees)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
