"""Ridges out of sums against fits on rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import linear


def rows_of(n=300):
    draw = random.Random(11)
    rows = [(i, draw.choice("abc"), draw.gauss(3, 2), float(draw.randrange(5)), 7.0, draw.gauss(0, 1)) for i in range(n)]
    rows = [(i, m, x, z, k, 2 * x - z + e) for i, m, x, z, k, e in rows]
    return [*rows, (n, "a", None, 1.0, 7.0, 1.0), (n + 1, "a", 1.0, 1.0, 7.0, None), (n + 2, "d", float("nan"), 1.0, 7.0, 1.0)]


KINDS = "id long, month string, x double, z double, k double, y double"


def plain(rows, weights, penalty):
    """(intercept, weights) by centred normal equations on the rows themselves."""
    x, y, w = (np.array(v, float) for v in ([r[2:5] for r in rows], [r[5] for r in rows], weights))
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    c = x - mx
    beta = np.linalg.solve((c * w[:, None]).T @ c + penalty * np.eye(3), (c * w[:, None]).T @ (y - my))
    return np.concatenate([[my - mx @ beta], beta])


def taught(rows):
    return [r for r in rows if all(v is not None and not math.isnan(v) for v in r[2:])]


def test_each_month_by_all_others(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, KINDS).repartition(5)
    models = linear.leave_one_out(frame, ["x", "z", "k"], "y", "month", 1.5)
    assert sorted(models) == ["a", "b", "c", "d"]
    for month, model in models.items():
        own = [r for r in taught(rows) if r[1] != month]
        assert model == pytest.approx(plain(own, [1] * len(own), 1.5), abs=1e-8)
        assert model[3] == pytest.approx(0, abs=1e-9)  # constant
    scored = {r["id"]: r["score"] for r in linear.scored_by_fold(frame, models, ["x", "z", "k"], "month").collect()}
    assert len(scored) == len(rows) and scored[300] is None
    for i, m, *values in rows[:50]:
        assert scored[i] == pytest.approx(models[m][0] + np.dot(models[m][1:], values[:3]))


def drawn(seed, replica, key):
    u = int(hashlib.md5(f"{seed}-{replica}-{key}".encode()).hexdigest()[:8], 16) / 2**32
    times, level = 0, 0.0
    for i in range(8):
        level += math.exp(-1) / math.factorial(i)
        times += u >= level
    return times


def test_bags_in_one_job(spark):
    rows = rows_of(200)
    frame = spark.createDataFrame(rows, KINDS)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bags", "bags")
    models = linear.bags(frame, ["x", "z", "k"], "y", "id", 25, 2.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("bags")) <= 2  # the shuffle's stage and the result, whatever the replicas
    own = taught(rows)
    for replica, model in enumerate(models):
        assert model == pytest.approx(plain(own, [drawn("bag", replica, r[0]) for r in own], 2.0), abs=1e-8)
    other = linear.bags(frame.repartition(7), ["x", "z", "k"], "y", "id", 25, 2.0)
    assert np.allclose(models, other)
    assert len({round(m[1], 9) for m in models}) == 25
    found = linear.bagged(frame.where("x IS NOT NULL AND NOT isnan(x)"), models, ["x", "z", "k"], "id", ["month"]).collect()
    assert len(found) == 201 and all(0 < r["score"] <= 1 and r["spread"] >= 0 for r in found)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], KINDS)
    assert linear.leave_one_out(empty, ["x", "z"], "y", "month") == {}
    assert [m.tolist() for m in linear.bags(empty, ["x", "z"], "y", "id", 2)] == [[0, 0, 0], [0, 0, 0]]
    alone = spark.createDataFrame([(1, "a", 1.0, 2.0, 7.0, 3.0)], KINDS)
    assert linear.leave_one_out(alone, ["x", "z"], "y", "month")["a"].tolist() == [0, 0, 0]
    assert linear.scored_by_fold(alone, {"a": np.zeros(3)}, ["x", "z"], "month").select(F.sum("score")).first()[0] == 0
