"""Ranks, cohort scoring, fusion of lanes, quota interleave, and what measures them.

Ranks and row numbers come from ``ordering``: cohorts of any size are dealt out over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordering import met, numbered, quantiles, rank_of, ranked, value_places

FUSION = 20
LEAST_KNOWN = 8
MIN_COHORT = 12
QUOTA = 0.3


def average_rank(rows: DataFrame, value: str, by: list[str], name: str, descending: bool = False) -> DataFrame:
    """``rows`` with the rank of ``value`` from 1 within ``by``, ties averaged."""
    return ranked(rows, value, by, {name: rank_of(descending)})


def percentile_rank(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Average rank over n + 1: always inside (0, 1); one value alone gets 0.5."""
    return ranked(rows, value, by, {name: rank_of() / (F.col("n_total") + 1)})


def share_rank(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Average rank over n."""
    return ranked(rows, value, by, {name: rank_of() / F.col("n_total")})


def partial_lane(rows: DataFrame, value: str, by: list[str], name: str, least: int = LEAST_KNOWN) -> DataFrame:
    """Adds rank ``name``: known values best first, unknown at their middle; null where too few are known or all are equal."""
    known = rows.where(F.col(value).isNotNull())
    lane = value_places(known, value, by).select(*by, value, rank_of(descending=True).alias("_rank"))
    told = known.groupBy(*by).agg(F.count("*").alias("_n"), (F.min(value) != F.max(value)).alias("_vary"))
    active = (F.col("_n") >= least) & F.col("_vary")
    joined = met(met(rows, lane, [*by, value]), told, by)
    return joined.withColumn(name, F.when(active, F.when(F.col(value).isNotNull(), F.col("_rank")).otherwise((F.col("_n") + 1) / 2))).drop("_rank", "_n", "_vary")


def fused(ranks: list[Column], k: int = FUSION) -> Column:
    """Reciprocal rank fusion; lanes that are null add nothing."""
    return sum((F.coalesce(1 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def cohort(rows: DataFrame, category: Column, name: str, least: int = MIN_COHORT) -> DataFrame:
    """``rows`` with the category, ``unknown`` if blank, pooled with other small ones."""
    own = F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("unknown"))
    named = rows.withColumn(name, own)
    small = named.groupBy(name).agg(F.count("*").alias("_n")).where(F.col("_n") < least)
    return met(named, small, [name]).withColumn(name, F.when(F.col("_n").isNotNull(), "(small fields)").otherwise(F.col(name))).drop("_n")


def tier(percentile: Column) -> Column:
    return F.when(percentile >= 0.95, "headline").when(percentile >= 0.8, "notable").otherwise("rest")


def signal_scores(rows: DataFrame, weights: dict[str, float], by: list[str], key: str) -> DataFrame:
    """(by, key, signal_total, reasons): weighted percentiles of the signals and the three best reasons.

    Signals are unpivoted, so all percentiles come out of one count of values whatever their number."""
    long = rows.select(*by, key, F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in weights]), F.array(*[F.col(x).cast("double") for x in weights]))).alias("signal", "value"))
    table = F.create_map(*[F.lit(y) for x in weights.items() for y in x])
    weighed = percentile_rank(long, "value", [*by, "signal"], "pct").withColumn("w", table[F.col("signal")])
    reasons = F.array_sort(F.collect_list(F.when(F.col("w") * (F.col("pct") - 0.5) > 0, F.struct(F.round(-F.col("w") * (F.col("pct") - 0.5), 12).alias("minus"), F.col("signal").alias("signal")))))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("signal", (F.col("w") * F.col("pct")).alias("x")))), F.lit(0.0), lambda a, x: a + x["x"])
    return weighed.groupBy(*by, key).agg(total.alias("signal_total"), F.transform(F.slice(reasons, 1, 3), lambda x: x["signal"]).alias("reasons"))


def interleave(rows: DataFrame, newcomer: str, by: list[str], order: list[Column], quota: float = QUOTA) -> DataFrame:
    """Adds ``position`` from 1: newcomers take every 1/quota-th place or so, each kind in its own ``order``.

    Closed form of the loop that places a newcomer once (placed + 1) * quota passes its number + 0.5."""
    lanes = numbered(rows, [*by, newcomer], order, "_number")
    old = rows.groupBy(*by).agg(F.count_if(~F.col(newcomer)).alias("_e"))
    at = met(lanes.withColumn("_j", F.col("_number") - 1), old, by)
    late = F.least(F.greatest(F.floor((F.col("_j") + 0.5) / quota) - F.col("_j"), F.lit(0)), F.col("_e"))
    keyed = at.withColumn("_key", F.when(F.col(newcomer), late).otherwise(F.col("_j"))).withColumn("_lane", F.when(F.col(newcomer), 0).otherwise(1))
    return numbered(keyed, by, [F.col("_key"), F.col("_lane"), F.col("_j")], "position").drop("_number", "_j", "_e", "_key", "_lane")


def auc(scores: DataFrame, score: str, hit: str, by: list[str]) -> DataFrame:
    """(by, n, positives, auc): Mann-Whitney from average ranks, out of counts of scores alone; null without both kinds."""
    places = value_places(scores, score, by, {"_hits": F.sum(F.col(hit).cast("long"))})
    positives, n = F.sum("_hits"), F.sum("n_equal")
    return places.groupBy(*by).agg(
        n.alias("n"),
        positives.alias("positives"),
        F.try_divide(F.sum(F.col("_hits") * rank_of()) - positives * (positives + 1) / 2, positives * (n - positives)).alias("auc"),
    )


def best(rows: DataFrame, order: list[Column], by: list[str], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each cohort in ``order``, with their number; tasks pass on ``k`` rows a cohort at most."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def ndcg(scores: DataFrame, score: str, label: str, key: str, by: list[str], k: int) -> DataFrame:
    """(by, ndcg) with gain ln(1 + label) and discount log2(rank + 1); null where the ideal is 0."""
    gain = F.sum(F.log1p(F.col(label).cast("double")) / F.log2(F.col("_r") + 1))
    lane = lambda c, name: best(scores, [F.col(c).desc(), F.col(key)], by, k, "_r").groupBy(*by).agg(gain.alias(name))
    return met(lane(score, "_own"), lane(label, "_ideal"), by).select(*by, F.try_divide("_own", "_ideal").alias("ndcg"))


def top_k_quality(scores: DataFrame, score: str, hit: str, key: str, by: list[str], k: int) -> DataFrame:
    """(by, recall, lift, median_percentile) of the k best."""
    top = best(scores, [F.col(score).desc(), F.col(key)], by, k, "_r").groupBy(*by).agg(F.sum(hit).alias("_top"))
    whole = scores.groupBy(*by).agg(F.sum(hit).alias("_hits"), F.count("*").alias("_n"))
    middle = quantiles(share_rank(scores, score, by, "_p").where(F.col(hit) == 1), "_p", by, {"median_percentile": 0.5})
    size = F.least(F.lit(k), F.col("_n"))
    return met(met(whole, top, by), middle, by).select(
        *by, F.try_divide("_top", "_hits").alias("recall"), F.try_divide(F.col("_top") / size, F.col("_hits") / F.col("_n")).alias("lift"), "median_percentile"
    )


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    both = average_rank(average_rank(rows, x, by, "_x"), y, by, "_y")
    return both.groupBy(*by).agg(F.corr("_x", "_y").alias("spearman"))


def overlap_at_k(rows: DataFrame, a: str, b: str, key: str, by: list[str], k: int) -> DataFrame:
    lane = lambda c: best(rows, [F.col(c).desc(), F.col(key)], by, k, "_r").select(*by, key)
    shared = lane(a).withColumn("_in", F.lit(1))
    return met(lane(b), shared, [*by, key]).groupBy(*by).agg((F.coalesce(F.sum("_in"), F.lit(0)) / k).alias("overlap"))
