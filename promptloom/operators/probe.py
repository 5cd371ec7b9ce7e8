"""Linear probe over sparse feature maps, and the error-detection job built on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from promptloom.functions.draws import chance
from promptloom.operators.ranges import numbered
from promptloom.session import reread, stored

#: Rounds of Newton's method; features that it is used up to; the largest change of a weight.
NEWTON_ROUNDS, NEWTON_FEATURES, LONGEST_STEP = 12, 200, 4.0


def labelled(correct: DataFrame, errors: DataFrame, text: str, prompt: str = "prompt") -> DataFrame:
    """Correct rows with label 1 and error rows with label 0, the text as ``prompt``."""
    parts = [
        rows.withColumnRenamed(text, prompt).withColumn("label", F.lit(label))
        for rows, label in ((correct, 1), (errors, 0))
    ]
    return parts[0].unionByName(parts[1])


def feature_index(rows: DataFrame, representation: str = "representation") -> DataFrame:
    """(feature, idx): all feature keys, sorted, numbered from 0 range by range."""
    keys = rows.select(F.explode(F.map_keys(representation)).alias("feature")).distinct()
    return numbered(keys, ["feature"], "idx").select("feature", F.col("idx").cast("int").alias("idx"))


# Fixed value: how a sparse vector is stored (type 0).
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def feature_entries(
    rows: DataFrame, index: DataFrame, key: str, label: str, size: int,
    representation: str = "representation",
) -> DataFrame:
    """(key, label, features): one sparse vector per row, as the struct vectors are stored in;
    a row's own map bounds its size."""
    entries = rows.select(key, label, F.explode_outer(representation).alias("feature", "value"))
    pairs = F.collect_list(
        F.when(F.col("idx").isNotNull(), F.struct("idx", F.col("value").cast("double").alias("value")))
    )
    vector = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"),
        F.col("_pairs")["idx"].alias("indices"), F.col("_pairs")["value"].alias("values"),
    )
    return (
        entries.join(index, "feature", "left")
        .groupBy(key, label)
        .agg(F.array_sort(pairs).alias("_pairs"))
        .select(key, label, vector.cast(_SPARSE).alias("features"))
    )


def as_vectors(table: DataFrame, *columns: str) -> DataFrame:
    """A table of :func:`feature_entries` that was stored, its structs read as vectors."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    schema = StructType([StructField(c, VectorUDT() if c == "features" else kinds[c]) for c in columns])
    return reread(table, schema)


def is_test(key: Column, seed: int, share: float) -> Column:
    """The seeded shuffle of the rows, as far as the split needs it: a draw per row."""
    return chance(share, seed, key, "probe_split")


def strongest(weights: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` (idx, importance) with the largest importance, the smaller idx among equals."""
    return weights.orderBy(F.desc("importance"), "idx").limit(top_k)


def accuracy(predictions: DataFrame, label: str = "label") -> DataFrame:
    hit = (F.col("prediction") == F.col(label)).cast("int")
    return predictions.agg(F.avg(hit).alias("accuracy"), F.count("*").alias("rows"))


@dataclass
class NewtonModel:
    """Weights of a logistic probe for labels 0 and 1, and its constant."""

    weights: list[float]
    intercept: float

    def margin(self, features: str = "features") -> Column:
        """Of a sparse vector, the logarithm of the odds of label 1."""
        weights = F.array(*[F.lit(w) for w in self.weights]) if self.weights else F.array(F.lit(0.0))
        pairs = F.arrays_zip(F.col(features)["indices"].alias("i"), F.col(features)["values"].alias("x"))
        return F.aggregate(pairs, F.lit(self.intercept), lambda total, p: total + p["x"] * F.get(weights, p["i"]))


def newton_probe(
    rows: DataFrame, size: int, label: str = "label", rounds: int = NEWTON_ROUNDS, ridge: float = 1.0
) -> NewtonModel:
    """Logistic regression for labels 0 and 1 by a fixed number of Newton rounds.

    ``rows`` hold sparse vectors as structs (:func:`feature_entries`). A round is one aggregation:
    the slope and the weighted Gram matrix, summed in each task before the shuffle, come to the
    driver ((size + 1) * (size + 4) / 2 numbers) and give the next step, at most ``LONGEST_STEP``
    in any weight. The penalty is half of ``ridge`` times the squared weights, the constant is free.
    """
    model = NewtonModel([0.0] * size, 0.0)
    zipped = F.arrays_zip(F.col("features")["indices"].alias("i"), F.col("features")["values"].alias("x"))
    constant = F.array(F.struct(F.lit(size).alias("i"), F.lit(1.0).alias("x")))
    penalty = np.diag([ridge] * size + [0.0])
    for _ in range(rounds):
        chance_of_1 = 1 / (1 + F.exp(-F.least(F.greatest(model.margin(), F.lit(-30.0)), F.lit(30.0))))
        slopes = rows.select(F.concat(zipped, constant).alias("f"), F.col(label).cast("double").alias("y"), chance_of_1.alias("p"))
        slope = F.struct(F.lit(-1).alias("i"), (F.col("p") - F.col("y")).alias("x"))
        curve = F.transform("f", lambda e: F.struct(e["i"].alias("i"), (e["x"] * F.col("p") * (1 - F.col("p"))).alias("x")))
        entry = "array<struct<i:int,x:double>>"
        others = F.concat(F.array(slope).cast(entry), curve.cast(entry))
        one = slopes.select(F.explode("f").alias("e"), others.alias("others"))
        both = one.select(F.col("e.i").alias("i"), F.col("e.x").alias("x"), F.inline("others").alias("j", "z"))
        sums = both.where("j <= i").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("s")).collect()
        gram, gradient = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
        for i, j, s in sorted((r["i"], r["j"], r["s"]) for r in sums):
            if j < 0:
                gradient[i] = s
            else:
                gram[i, j] = gram[j, i] = s
        weights = np.array([*model.weights, model.intercept])
        step = np.linalg.solve(gram + penalty + 1e-9 * np.eye(size + 1), gradient + penalty @ weights)
        step *= min(1.0, LONGEST_STEP / max(np.abs(step).max(), 1e-300))
        model = NewtonModel([float(w) for w in (weights - step)[:-1]], float((weights - step)[-1]))
    return model


@dataclass
class Probe:
    """A trained probe with its test predictions and strongest features."""

    model: NewtonModel | LogisticRegressionModel
    predictions: DataFrame
    accuracy: DataFrame
    top_features: DataFrame


def train_probe(
    rows: DataFrame, key: str, label: str = "label", representation: str = "representation",
    top_k: int = 5, seed: int = 42, test: float = 0.2, max_iter: int = 1000,
) -> Probe:
    """Logistic regression on feature maps: accuracy on a seeded fifth of the rows, and
    the features with the largest absolute weight (mean over classes when there are
    more than two). The penalty matches one unit of squared weights against the summed
    loss, so it shrinks with the number of training rows.

    Labels 0 and 1 with at most ``NEWTON_FEATURES`` features are fitted by Newton's method, which
    any engine can repeat; more classes or features by MLlib's quasi-Newton method, to the
    same optimum."""
    index = stored(feature_index(rows, representation))
    size = index.count()
    entries = feature_entries(rows, index, key, label, size, representation)
    table = stored(entries.withColumn("test", is_test(F.col(key), seed, test)))
    labels = {r[0] for r in table.select(label).distinct().limit(3).collect()}
    if size <= NEWTON_FEATURES and labels <= {0, 1}:
        model = newton_probe(table.where("NOT test"), size, label)
        hit = (model.margin() > 0).cast("double").alias("prediction")
        predictions = table.where("test").select(key, label, hit)
        weights = np.abs(model.weights)
    else:
        data = as_vectors(table, key, label, "features", "test")
        train = data.where("NOT test")
        model = LogisticRegression(
            labelCol=label, maxIter=max_iter, regParam=1.0 / max(train.count(), 1), standardization=False
        ).fit(train)
        predictions = model.transform(data.where("test")).select(key, label, "prediction")
        # The weights of a model come to the driver in one piece; their ranking doesn't stay there.
        weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    rows_of = [(i, float(w)) for i, w in enumerate(weights)]
    top = strongest(rows.sparkSession.createDataFrame(rows_of, "idx int, importance double"), top_k)
    top_features = top.join(index, "idx").select("feature", "importance")
    return Probe(model, predictions, accuracy(predictions, label), top_features)


def detect_errors(
    correct: DataFrame, errors: DataFrame, key: str, text: str, represent, top_k: int = 5,
    seed: int = 42,
) -> Probe:
    """Error detection: labelled union, split by a seeded draw, probe on ``represent(prompt)``."""
    rows = labelled(correct, errors, text)
    mapped: Column = represent(F.col("prompt"))
    return train_probe(rows.withColumn("representation", mapped), key, top_k=top_k, seed=seed)
