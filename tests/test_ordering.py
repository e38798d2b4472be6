"""Order statistics dealt out over tasks, against plain ones; and what their plans must not hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, graph, grid, ordering, ranking

KINDS = "id long, g string, v double, hit int"


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def rows_of(n, groups, seed=1, ties=40):
    draw = random.Random(seed)
    value = lambda: draw.choice([None, float("nan"), -0.0, 0.0, math.inf]) if draw.random() < 0.05 else float(draw.randrange(ties)) if draw.random() < 0.5 else draw.random()
    return [(i, draw.choice(groups), value(), draw.randrange(2)) for i in range(n)]


def key(v):
    """Spark's order: nulls, numbers, NaN."""
    return (0, 0) if v is None else (2, 0) if math.isnan(v) else (1, v + 0.0)


def plain_ranks(rows):
    found = {}
    for g in {r[1] for r in rows}:
        own = [key(r[2]) for r in rows if r[1] == g]
        for i, h, v, _ in rows:
            if h == g:
                below, equal = sum(x < key(v) for x in own), sum(x == key(v) for x in own)
                found[i] = (below + (equal + 1) / 2, len(own))
    return found


@pytest.mark.parametrize("groups", [["one"], ["a", "b", None, "rare"]])
def test_ranks_over_many_partitions(spark, many_parts, groups):
    rows = rows_of(900, groups)
    frame = spark.createDataFrame(rows, KINDS).repartition(8)
    expected = plain_ranks(rows)
    found = {r["id"]: r["r"] for r in ranking.average_rank(frame, "v", ["g"], "r").collect()}
    assert found == {i: r for i, (r, _) in expected.items()}
    found = {r["id"]: r["r"] for r in ranking.average_rank(frame, "v", ["g"], "r", descending=True).collect()}
    assert found == {i: n + 1 - r for i, (r, n) in expected.items()}
    found = {r["id"]: r["p"] for r in ranking.percentile_rank(frame, "v", ["g"], "p").collect()}
    assert all(found[i] == pytest.approx(r / (n + 1)) and 0 < found[i] < 1 for i, (r, n) in expected.items())


def test_one_cohort_lies_in_many_ranges(spark, many_parts):
    frame = spark.range(20_000).select("id", F.lit("one").alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    spread = ordering._ranged(frame, ["g"], [F.col("v")])
    sizes = [r["count"] for r in spread.groupBy("_range").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 5 * 20_000 / 64
    numbers = {r["v"]: r["n"] for r in ordering.numbered(frame, ["g"], [F.col("v").desc()], "n").collect()}
    assert [numbers[v] for v in sorted(numbers, reverse=True)] == list(range(1, 20_001))


def test_a_value_that_most_rows_have(spark, many_parts):
    """Ties melt where they are read: the ranges get one row of a value."""
    frame = spark.range(50_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).cast("double").alias("v"))
    found = ranking.average_rank(frame, "v", [], "r")
    tied = 50_000 - 16_667
    assert found.where("v = -1").agg(F.min("r"), F.max("r"), F.count("*")).first()[:] == ((tied + 1) / 2, (tied + 1) / 2, tied)
    assert ordering.value_places(frame, "v", []).count() == 16_668


def test_row_before(spark, many_parts):
    rows = rows_of(400, ["a", "b"], 3)
    frame = spark.createDataFrame(rows, KINDS)
    found = {r["id"]: r["above"] for r in ordering.lagged(frame, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], "hit", "above").collect()}
    for g in "ab":
        own = sorted([r for r in rows if r[1] == g], key=lambda r: r[0])
        own.sort(key=lambda r: key(r[2]), reverse=True)
        assert [found[r[0]] for r in own] == [None, *[r[3] for r in own[:-1]]]


def test_quantiles_by_cohort(spark, many_parts):
    rows = [(i, g, None if v is None or math.isnan(v) or math.isinf(v) else v, h) for i, g, v, h in rows_of(700, ["a", "b", None], 5)]
    rows += [(10_000, "alone", 3.0, 1), (10_001, "unknown", None, 1)]
    found = {r["g"]: r for r in ordering.quantiles(spark.createDataFrame(rows, KINDS), "v", ["g"], {"low": 0.005, "mid": 0.5, "top": 0.9, "end": 1.0}).collect()}
    assert "unknown" not in found and found["alone"]["mid"] == 3.0
    for g in ("a", "b", None):
        own = [v for _, h, v, _ in rows if h == g and v is not None]
        for name, p in (("low", 0.005), ("mid", 0.5), ("top", 0.9), ("end", 1.0)):
            assert found[g][name] == pytest.approx(np.quantile(own, p))


@pytest.mark.parametrize("accuracy,held", [(40, 60), (10_000, 10_000)])
def test_selection(spark, accuracy, held):
    """With small sketches several rounds are made, and some miss."""
    draw = np.random.default_rng(accuracy)
    columns = {
        "normal": draw.normal(size=2_000) * 1e300,
        "ends": np.concatenate([np.zeros(990), np.ones(990), draw.uniform(0.1, 0.9, 20)]),
        "spikes": np.where(draw.random(2_000) < 0.4, 0.25, draw.random(2_000)),
    }
    rows = list(zip(*[c.tolist() for c in columns.values()], strict=True)) + [(None,) * 3, (float("nan"),) * 3]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(2).cache()
    wanted = {f"{c}_{p}": (c, p) for c, p in (("normal", 0.005), ("normal", 1.0), ("ends", 0.5), ("spikes", 0.3))}
    found = ordering.selected(frame, wanted, accuracy, held)
    for name, (c, p) in wanted.items():
        assert found[name] == pytest.approx(np.quantile(columns[c], p), rel=1e-12), name


def test_selection_of_nothing(spark):
    assert ordering.selected(spark.createDataFrame([(None,)], "v double"), {"m": ("v", 0.5)}) == {"m": None}
    assert ordering.selected(spark.createDataFrame([], "v double"), {"m": ("v", 0.5)}) == {"m": None}
    assert ordering.selected(spark.createDataFrame([(2,)], "v int"), {"m": ("v", 0.5)}) == {"m": 2.0}
    edges = grid.edges(spark.createDataFrame([], "x double, y double")).first()
    assert edges["x_lo"] is None and edges["y_hi"] is None


def windows(frame):
    """Columns that windows of a plan are partitioned by."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window")]


def test_plans_hold_no_cohort_window_and_no_global_quantile(spark):
    frame = spark.createDataFrame(rows_of(60, ["a", "b"]), KINDS).withColumn("known", F.col("v")).withColumn("newcomer", F.col("hit") == 1)
    frames = {
        "ranks": ranking.percentile_rank(frame, "v", ["g"], "p"),
        "lane": ranking.partial_lane(frame, "known", ["g"], "lane"),
        "interleave": ranking.interleave(frame, "newcomer", ["g"], [F.col("v"), F.col("id")]),
        "auc": ranking.auc(frame, "v", "hit", ["g"]),
        "quality": ranking.top_k_quality(frame, "v", "hit", "id", ["g"], 5),
        "cutoff": evaluation.cutoff_quality(frame, "v", "v", "id", ["g"], 5),
        "summary": evaluation.label_summary(frame, "v", ["g"]),
        "fade": evaluation.position_fade(frame, [F.col("v"), F.col("id")], ["g"]),
        "edges": grid.edges(frame.selectExpr("v AS x", "v AS y")),
        "hubs": graph.hubs(frame.selectExpr("id AS paper", "0 AS t"), frame.selectExpr("id AS src", "hit AS dst", "0 AS t_src"), 1),
    }
    for name, found in frames.items():
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan, name
        for line in windows(found):
            # Over cohorts alone only the ranges' sums go, a row a range; and the best k, which tasks cut before they pass them on.
            assert "_range" in line or "row_number()" in line and "WindowGroupLimit" in plan, (name, line)


def max_min(rows):
    """{value: fitted} by the max-min formula."""
    values = sorted({r[0] for r in rows})
    w = np.array([sum(1 for r in rows if r[0] == v) for v in values], float)
    s = np.array([sum(r[1] for r in rows if r[0] == v) for v in values], float)
    mean = lambda j, k: s[j : k + 1].sum() / w[j : k + 1].sum()
    return {v: max(min(mean(j, k) for k in range(i, len(values))) for j in range(i + 1)) for i, v in enumerate(values)}


@pytest.mark.parametrize("shape", ["rising", "falling", "noisy", "tied"])
def test_isotonic_fit_over_ranges(spark, shape):
    draw = random.Random(shape)
    n = 60
    label = {"rising": lambda i: i, "falling": lambda i: -i, "noisy": lambda i: i + draw.randrange(40), "tied": lambda i: draw.randrange(2)}[shape]
    rows = [(float(i % 25 if shape == "tied" else i), float(label(i))) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "v double, y double")
        levels = [tuple(r) for r in ordering.isotonic(frame, "v", "y", together=2).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    for value, fitted in max_min(rows).items():
        assert [f for low, high, _, f in levels if low <= value <= high] == [pytest.approx(fitted)]
    told = {r["v"]: r["fitted"] for r in ordering.fitted(frame, "v", spark.createDataFrame(levels, "low double, high double, weight double, fitted double")).collect()}
    assert told == {v: pytest.approx(f) for v, f in max_min(rows).items()}
    assert sum(w for _, _, w, _ in levels) == n and len(levels) == {"rising": n, "falling": 1}.get(shape, len(levels))
    assert ordering.isotonic(spark.createDataFrame([], "v double, y double"), "v", "y").count() == 0
