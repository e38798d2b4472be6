"""Ranking models on MLlib, their evaluation by held-out months, calibration and audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators.ordering import met, quantiles
from sparkloom.operators.ranking import best, percentile_rank, share_rank

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def percentile_features(rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Each feature replaced by its percentile within the cohort."""
    for c in features:
        rows = percentile_rank(rows, c, by, "_pct").drop(c).withColumnRenamed("_pct", c)
    return rows


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``_w``, so that both classes weigh the same."""
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    return rows.withColumn("_w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))


def nonnegative_logistic(features: list[str], label: str, c: float = 0.05) -> Fit:
    """L2 logistic without intercept, weights at least 0; the penalty is per summed loss, hence 1 / (c * weights)."""

    def fit(rows: DataFrame):
        weighed = balanced(rows, label).withColumn("_y", F.col(label).cast("double"))
        total = weighed.agg(F.sum("_w")).first()[0] or 1.0
        model = LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", fitIntercept=False, standardization=False, regParam=1 / (c * total),
            lowerBoundsOnCoefficients=Matrices.dense(1, len(features), [0.0] * len(features)),
        ).fit(_assembled(weighed, features))
        return lambda new: model.transform(_assembled(new, features)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*new.columns, "score")

    return fit


def logistic(features: list[str], label: str, c: float = 0.5) -> Fit:
    """Balanced, standardised logistic regression."""

    def fit(rows: DataFrame):
        weighed = balanced(rows, label).withColumn("_y", F.col(label).cast("double"))
        total = weighed.agg(F.sum("_w")).first()[0] or 1.0
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", standardization=True, regParam=1 / (c * total)).fit(_assembled(weighed, features))
        return lambda new: model.transform(_assembled(new, features)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*new.columns, "score")

    return fit


def _regression(estimator, features: list[str], label: str) -> Fit:
    def fit(rows: DataFrame):
        model = estimator().fit(_assembled(rows.withColumn("_y", F.col(label).cast("double")), features))
        return lambda new: model.transform(_assembled(new, features)).withColumn("score", F.col("prediction")).select(*new.columns, "score")

    return fit


def ridge(features: list[str], label: str, penalty: float = 1.0) -> Fit:
    return _regression(lambda: LinearRegression(featuresCol="_x", labelCol="_y", elasticNetParam=0.0, regParam=penalty), features, label)


def poisson(features: list[str], label: str, penalty: float = 1e-3) -> Fit:
    return _regression(lambda: GeneralizedLinearRegression(featuresCol="_x", labelCol="_y", family="poisson", link="log", regParam=penalty), features, label)


def boosted_regression(features: list[str], label: str, rounds: int = 300, seed: int = 7) -> Fit:
    return _regression(lambda: GBTRegressor(featuresCol="_x", labelCol="_y", maxDepth=3, stepSize=0.06, maxIter=rounds, minInstancesPerNode=40, seed=seed), features, label)


def boosted_classifier(features: list[str], label: str, rounds: int = 300, seed: int = 7) -> Fit:
    def fit(rows: DataFrame):
        weighed = balanced(rows, label).withColumn("_y", F.col(label).cast("double"))
        model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=3, stepSize=0.06, maxIter=rounds, seed=seed).fit(_assembled(weighed, features))
        return lambda new: model.transform(_assembled(new, features)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*new.columns, "score")

    return fit


def pairwise(features: list[str], label: str, key: str, by: list[str], pairs: int = 2_000, c: float = 1.0) -> Fit:
    """Learning to rank on differences of rows of one cohort. Each row meets partners by a rotation of a seeded order:
    about ``pairs`` a cohort, so no cohort's pairs are all formed."""
    from pyspark.sql import Window

    def fit(rows: DataFrame):
        w = Window.partitionBy(*by)
        placed = rows.withColumn("_i", F.row_number().over(w.orderBy(F.xxhash64(F.lit("pairs"), key), key)) - 1).withColumn("_n", F.count("*").over(w))
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.ceil(F.lit(pairs) / F.col("_n")), F.col("_n") - 1)).cast("int"))
        a = placed.where("_n > 1").withColumn("_s", F.explode(steps)).withColumn("_j", F.pmod(F.col("_i") + F.col("_s"), F.col("_n")))
        b = placed.select(*[F.col(x).alias(f"_b_{x}") for x in [*by, *features, label]], F.col("_i").alias("_j"))
        joined = a.join(b, [a["_j"] == b["_j"], *[a[x] == b[f"_b_{x}"] for x in by]]).where(F.col(label) != F.col(f"_b_{label}"))
        diff = joined.select(*[(F.col(x) - F.col(f"_b_{x}")).alias(x) for x in features], (F.col(label) > F.col(f"_b_{label}")).cast("double").alias("_y"), F.abs(F.col(label) - F.col(f"_b_{label}")).cast("double").alias("_w"))
        total = diff.agg(F.sum("_w")).first()[0] or 1.0
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", fitIntercept=False, standardization=False, regParam=1 / (c * total)).fit(_assembled(diff, features))
        weights = model.coefficients.toArray().tolist()
        score = reduce(lambda x, y: x + y, [F.lit(w_) * F.col(f) for w_, f in zip(weights, features, strict=True)])
        return lambda new: new.withColumn("score", score)

    return fit


def leave_one_month_out(rows: DataFrame, month: str, fit: Fit) -> DataFrame:
    """Out-of-fold scores: each month by a model of all others. The months are few and listed on the driver."""
    months = [r[0] for r in rows.select(month).distinct().orderBy(month).collect()]
    return reduce(DataFrame.unionByName, [fit(rows.where(F.col(month) != m))(rows.where(F.col(month) == m)) for m in months])


def rolling_folds(months: list[int], horizon: int, folds: int, least: int) -> list[tuple[list[int], list[int]]]:
    """(train, test) months, where a training month's label is complete before the test begins."""
    tested = months[least:]
    size = max(1, -(-len(tested) // folds))
    cut = [tested[i : i + size] for i in range(0, len(tested), size)]
    return [(train, test) for test in cut if (train := [m for m in months if m + horizon <= test[0]])]


def isotonic_grid(scores: DataFrame, percentile: str, hit: str, points: int = 41) -> list[float]:
    """Calibrated probabilities at evenly spaced percentiles."""
    model = IsotonicRegression(featuresCol="_p", labelCol="_y").fit(scores.select(F.col(percentile).alias("_p"), F.col(hit).cast("double").alias("_y")))
    spark = scores.sparkSession
    grid = spark.range(points).select("id", (F.col("id") / (points - 1)).alias("_p"))
    return [min(max(r["prediction"], 0.0), 1.0) for r in model.transform(grid).orderBy("id").collect()]


def calibration_bands(scores: DataFrame, percentile: str, hit: str, edges: list[float]) -> DataFrame:
    """(band, n, rate, rises): hit rate by band, and whether it is no lower than the band before."""
    from pyspark.sql import Window

    band = reduce(lambda a, e: a + (F.col(percentile) > e).cast("int"), edges[1:-1], F.lit(0))
    found = scores.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("double")).alias("rate"))
    return found.withColumn("rises", F.coalesce(F.col("rate") >= F.lag("rate").over(Window.orderBy("band")), F.lit(True)))


def noisy(rows: DataFrame, features: list[str], share: float, key: str, seed: str) -> DataFrame:
    """Features times 1 + share * normal noise of seed, feature and key: the same however rows are dealt out."""
    return rows.withColumns({f: F.col(f) * (1 + share * scalars.seeded_normal(F.concat_ws("-", F.lit(seed), F.lit(f), F.col(key).cast("string")))) for f in features})


def rank_spread(replicas: DataFrame, score: str, key: str, replica: str, by: list[str]) -> DataFrame:
    """(key, mean, spread) of normalised ranks over replicas."""
    ranked = share_rank(replicas, score, [replica, *by], "_r")
    return ranked.groupBy(key).agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("spread"))


def concentration(rows: DataFrame, weight: str, score: str, key: str, by: list[str], k: int) -> DataFrame:
    """(by, share): how much of the top k the 10 % with the largest ``weight`` hold."""
    top = met(best(rows, [F.col(score).desc(), F.col(key)], by, k, "_r"), quantiles(rows, weight, by, {"_cut": 0.9}), by)
    return top.groupBy(*by).agg(F.avg((F.col(weight) >= F.col("_cut")).cast("double")).alias("share"))


def age_normalised(rows: DataFrame, value: str, age: str) -> DataFrame:
    """Adds ``normal``: the value over the mean of its age, floored at 1e-6."""
    means = rows.groupBy(age).agg(F.avg(value).alias("_mean"))
    return met(rows, means, [age]).withColumn("normal", F.col(value) / F.greatest("_mean", F.lit(1e-6))).drop("_mean")
