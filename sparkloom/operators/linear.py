"""Many ridge regressions out of one aggregation: sums of products of each replica or fold, and small solves after.

A ridge needs of its rows only how many there are, the sums of its columns and of their products. Those of all replicas come out of one job,
summed where rows are read; those of a model without a fold are the whole's less the fold's, so folds cost no copies of rows. The solves are
of the features' number and as many as replicas or folds.

The intercept isn't penalised: sums are centred by their means. Weights of a bag are Poisson draws of mean 1 told by seed, replica and key, the limit of drawing with
replacement, so they don't follow partitions.

Defined cases: rows with a null feature or label don't teach and score null; a replica without rows scores 0; a feature that is constant has weight 0; repeated rows teach each
(with the same weights, as they have one key); an empty table gives no models and no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators.ordering import met
from sparkloom.operators.ranking import share_rank

#: Most draws of a row in a bag; more have a chance under 1e-6.
MOST_DRAWS = 8


def _sums(features: list[str], label: str, weight: Column) -> list[Column]:
    """Weighted sums of 1, the columns, and their products, as ``solved`` reads them."""
    every = [F.col(c).cast("double") for c in [*features, label]]
    terms = [F.lit(1.0), *every, *[every[i] * every[j] for i in range(len(every)) for j in range(i, len(every))]]
    return [F.sum(weight * t).alias(f"_s{i}") for i, t in enumerate(terms)]


def _known(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*features, label]]))


def solved(sums: np.ndarray, features: int, penalty: float) -> np.ndarray:
    """(intercept, weights) from one row of sums."""
    n = sums[0]
    if n <= 0:
        return np.zeros(features + 1)
    linear, rest, at = sums[1 : features + 2], np.zeros((features + 1, features + 1)), features + 2
    for i in range(features + 1):
        for j in range(i, features + 1):
            rest[i, j] = rest[j, i] = sums[at]
            at += 1
    centred = rest - np.outer(linear, linear) / n
    weights = np.linalg.solve(centred[:-1, :-1] + penalty * np.eye(features), centred[:-1, -1])
    return np.concatenate([[(linear[-1] - linear[:-1] @ weights) / n], weights])


def draws(seed: str, replica: Column, key: Column) -> Column:
    """How often a replica draws a row: Poisson of mean 1."""
    u = scalars.seeded_uniform(F.concat_ws("-", F.lit(seed), replica.cast("string"), key.cast("string")))
    levels = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(MOST_DRAWS)]).tolist()
    return reduce(lambda a, b: a + b, [(u >= level).cast("int") for level in levels])


def bags(rows: DataFrame, features: list[str], label: str, key: str, replicas: int = 25, penalty: float = 1.0, seed: str = "bag") -> list[np.ndarray]:
    """A model of each replica, all out of one job over the rows."""
    # Copies of a row are summed at once, to a row a replica and task.
    copies = _known(rows, features, label).withColumn("_replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    summed = copies.groupBy("_replica").agg(*_sums(features, label, draws(seed, F.col("_replica"), F.col(key))))
    found = {r["_replica"]: np.array(r[1:]) for r in summed.collect()}
    none = np.zeros(len(summed.columns) - 1)
    return [solved(found.get(r, none), len(features), penalty) for r in range(replicas)]


def leave_one_out(rows: DataFrame, features: list[str], label: str, fold: str, penalty: float = 1.0) -> dict:
    """{fold: model of all other folds}; folds are few."""
    found = {r[fold]: np.array([r[f"_s{i}"] for i in range(len(r) - 1)]) for r in _known(rows, features, label).groupBy(fold).agg(*_sums(features, label, F.lit(1.0))).collect()}
    whole = sum(found.values())
    every = {r[0] for r in rows.select(fold).distinct().collect()}
    return {f: solved(whole - found.get(f, 0.0), len(features), penalty) for f in every} if found else {}


def predicted(model: np.ndarray, features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f) for f, w in zip(features, model[1:], strict=True)], F.lit(float(model[0])))


def scored_by_fold(rows: DataFrame, models: dict, features: list[str], fold: str) -> DataFrame:
    """``rows`` with ``score`` by the model that hasn't seen their fold."""
    spark = rows.sparkSession
    kind = rows.schema[fold].dataType.simpleString()
    table = spark.createDataFrame([(f, [float(x) for x in m]) for f, m in models.items()], f"{fold} {kind}, _model array<double>")
    joined = met(rows, table, [fold])
    score = reduce(lambda a, b: a + b, [F.get("_model", F.lit(i + 1)) * F.col(f) for i, f in enumerate(features)], F.get("_model", F.lit(0)))
    return joined.withColumn("score", score).drop("_model")


def bagged(rows: DataFrame, models: list[np.ndarray], features: list[str], key: str, by: list[str]) -> DataFrame:
    """(by, key, score, spread): mean and deviation of each row's normalised rank over the models; ranks are averaged, so that one unstable model moves little."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("replica"), predicted(m, features).alias("own")) for i, m in enumerate(models)]))
    long = rows.select(*by, key, each.alias("x")).select(*by, key, "x.replica", F.col("x.own").alias("own"))
    return share_rank(long, "own", ["replica", *by], "_rank").groupBy(*by, key).agg(F.avg("_rank").alias("score"), F.stddev_pop("_rank").alias("spread"))
