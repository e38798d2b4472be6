"""Models and their evaluation on a small made-up cohort table."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(600).select(F.col("id"), (F.col("id") % 3).cast("int").alias("month"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("n"))
    return base.withColumn("hit", (F.col("a") + 0.3 * F.col("n") > 0.9).cast("int")).withColumn("cites", (F.col("a") * 10).cast("int")).cache()


def right_way(scored):
    return scored.agg(F.corr("score", "a")).first()[0]


@pytest.mark.parametrize(
    "fit",
    [
        models.nonnegative_logistic(["a", "b"], "hit", 1.0),
        models.logistic(["a", "b"], "hit"),
        models.ridge(["a", "b"], "cites", 0.1),
        models.poisson(["a", "b"], "cites"),
        models.boosted_regression(["a", "b"], "cites", 5),
        models.boosted_classifier(["a", "b"], "hit", 5),
        models.pairwise(["a", "b"], "cites", "id", ["month"]),
    ],
)
def test_models_learn_the_signal(rows, fit):
    assert right_way(fit(rows)(rows)) > 0.5


def test_leave_one_month_out(rows):
    found = models.leave_one_month_out(rows, "month", models.logistic(["a", "b"], "hit"))
    assert found.count() == 600 and right_way(found) > 0.5


def test_folds():
    folds = models.rolling_folds(list(range(40)), 12, 3, 20)
    assert all(max(train) + 12 <= min(test) for train, test in folds) and sum(len(t) for _, t in folds) == 20


def test_calibration_and_audits(rows):
    scored = models.percentile_features(rows, ["a"], ["month"])
    grid = models.isotonic_grid(scored, "a", "hit")
    assert len(grid) == 41 and grid == sorted(grid)
    bands = models.calibration_bands(scored, "a", "hit", [0, 0.5, 0.8, 1]).collect()
    assert len(bands) == 3 and all(r["rises"] for r in bands)
    noised = [{r["id"]: r["a"] for r in models.noisy(rows.repartition(n), ["a"], 0.05, "id", "s").collect()} for n in (2, 5)]
    assert noised[0] == noised[1] and len(noised[0]) == 600
    replicas = rows.withColumn("replica", F.explode(F.array(F.lit(1), F.lit(2))))
    assert models.rank_spread(replicas, "a", "id", "replica", ["month"]).agg(F.max("spread")).first()[0] == 0
    assert all(0 < r["share"] <= 1 for r in models.concentration(rows, "a", "a", "id", ["month"], 10).collect())
    assert models.age_normalised(rows, "cites", "month").agg(F.avg("normal")).first()[0] == pytest.approx(1)
