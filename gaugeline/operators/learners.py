"""Classifiers of the risk audit, fitted on one split and scored on others with ``pyspark.ml``.

Missing features take the training split's median, classes weigh alike, and the metrics of each
model and split are those of ``audits.binary_audit``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from . import audits
from .ordering import kept


def text_features(text: Column) -> dict[str, Column]:
    """Numbers of a text that tell prose from junk; null of an empty one."""
    n = F.nullif(F.length(text), F.lit(0)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = F.nullif(F.size(words), F.lit(0)).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "size": F.log1p(n), "words": F.log1p(count), "word_length": n / count, "digits": share("[0-9]"), "marks": share("[#*$%&|<>]"),
        "capitals": share("[A-Z]"), "stops": share("[.!?]"), "distinct_words": F.size(F.array_distinct(F.transform(words, F.lower))) / count,
        "lines": F.regexp_count(text, F.lit("\n")) / n,
    }


def models(seed: int = 0, trees: int = 40, rounds: int = 30) -> dict:
    """The audit's classifiers by name."""
    common = {"featuresCol": "scaled", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(maxIter=200, **common),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, **common),
        "gradient_boosting": GBTClassifier(maxDepth=4, stepSize=0.1, maxIter=rounds, seed=seed, **common),
    }


def fit(train: DataFrame, features: list[str], label: str, classifiers: dict) -> dict:
    """Fitted pipelines by name; both classes weigh half of all rows."""
    rows = train.withColumn("label", F.col(label).cast("double"))
    n = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    share = {1.0: n["p"] or 0.0, 0.0: n["n"] - (n["p"] or 0.0)}
    weight = F.when(F.col("label") == 1.0, n["n"] / (2 * max(share[1.0], 1.0))).otherwise(n["n"] / (2 * max(share[0.0], 1.0)))
    rows = kept(rows.withColumn("weight", weight))
    filled = [f"{c}_filled" for c in features]
    prepare = [
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
    ]
    ready = Pipeline(stages=prepare).fit(rows)
    made = kept(ready.transform(rows).select("scaled", "label", "weight"))
    return {name: (ready, _stored(c.fit(made))) for name, c in classifiers.items()}


def _stored(model):
    """The model written and read back: without its training summary, which holds the session and can't go to tasks."""
    path = scratch(SparkSession.active(), "model")
    model.write().overwrite().save(path)
    return type(model).load(path)


def scored(rows: DataFrame, fitted) -> DataFrame:
    """``rows`` with ``score``, the probability of the positive class."""
    ready, model = fitted
    out = model.transform(ready.transform(rows))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def trained_audit(rows: DataFrame, features: list[str], label: str, split: str, train: str, classifiers: dict) -> DataFrame:
    """``model, split, n, positives, auc, f1, balanced_accuracy`` of each classifier on each split but ``train``."""
    rows = kept(rows)
    others = [r[0] for r in rows.select(split).distinct().collect() if r[0] != train]  # a few splits
    out = None
    for name, fitted in fit(rows.where(F.col(split) == train), features, label, classifiers).items():
        for other in sorted(others):
            s = kept(scored(rows.where(F.col(split) == other), fitted))
            n = s.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
            m = n.crossJoin(audits.binary_audit(s, F.col("score"), F.col(label) == 1))  # one row each
            m = m.select(F.lit(name).alias("model"), F.lit(other).alias("split"), "*")
            out = m if out is None else out.unionByName(m)
    return out
