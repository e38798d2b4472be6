"""What the study of rankers measures: cut-offs, paired tests, orientation, selection, agreement, sweeps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordering import met, numbered, quantiles
from sparkloom.operators.ranking import auc, best, percentile_rank, share_rank, spearman
from sparkloom.operators.tables import row_numbers


def cutoff_quality(scores: DataFrame, score: str, label: str, key: str, by: list[str], k: int, quantile: float = 0.9) -> DataFrame:
    """(by, precision, lift, top1): of the k best, the share whose label is in the cohort's top (the quantile, and 1 at least),
    their mean label over the cohort's, and whether the largest label is among them. Null where a cohort has fewer
    than two rows; precision also where no row is in the top, lift where the mean label is 0."""
    cut = quantiles(scores, label, by, {"_cut": quantile})
    hit = (F.col(label) >= F.greatest("_cut", F.lit(1.0))).cast("double")
    whole = met(scores, cut, by).groupBy(*by).agg(F.count("*").alias("_n"), F.sum(hit).alias("_hits"), F.avg(label).alias("_mean"), F.max(label).alias("_most"))
    top = met(best(scores, [F.col(score).desc(), F.col(key)], by, k, "_r"), cut, by)
    top = top.groupBy(*by).agg(F.avg(hit).alias("_precision"), F.avg(label).alias("_top_mean"), F.max(label).alias("_top_most"))
    enough = F.col("_n") >= 2
    return met(whole, top, by).select(
        *by,
        F.when(enough & (F.col("_hits") > 0), F.col("_precision")).alias("precision"),
        F.when(enough & (F.col("_mean") > 0), F.col("_top_mean") / F.col("_mean")).alias("lift"),
        F.when(enough, (F.col("_top_most") >= F.col("_most")).cast("double")).alias("top1"),
    )


def label_summary(rows: DataFrame, label: str, by: list[str]) -> DataFrame:
    """(by, n, mean, median, p90, largest, zeros) of a label."""
    summed = rows.groupBy(*by).agg(F.count(label).alias("n"), F.avg(label).alias("mean"), F.max(label).alias("largest"), F.avg((F.col(label) == 0).cast("double")).alias("zeros"))
    middle = quantiles(rows, label, by, {"median": 0.5, "p90": 0.9})
    return met(summed, middle, by).select(*by, "n", "mean", "median", "p90", "largest", "zeros")


def known_summary(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, value, known, positive, largest) of each of ``values``: how far a source knows them."""
    long = rows.select(*by, F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(v).cast("double") for v in values]))).alias("value", "x"))
    return long.groupBy(*by, "value").agg(F.count("x").alias("known"), F.count_if(F.col("x") > 0).alias("positive"), F.max("x").alias("largest"))


def length_bands(rows: DataFrame, items: str, edges: list[int], match: Column) -> DataFrame:
    """(band, n, rate): rows by how many items a list has, in bands that begin at ``edges``, and the share that ``match``."""
    size = F.greatest(F.size(items), F.lit(0))
    band = reduce(lambda a, e: F.when(size >= e, e).otherwise(a), sorted(edges), F.lit(0))
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.coalesce(match, F.lit(False)).cast("double")).alias("rate"))


def tallies(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """(by, n, flags): how many rows of each kind there are, and how many of them have each flag."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()])


def unpivoted(rows: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    return rows.select(*keep, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))).alias("feature", "value"))


def orientations(rows: DataFrame, features: list[str], label: str, binary: bool = True) -> DataFrame:
    """(feature, strength, sign): AUC less one half, or for labels that aren't 0 and 1 Spearman's correlation, and its sign (1 where it is 0 or unknown)."""
    long = unpivoted(rows, [label], features)
    if binary:
        found = auc(long, "value", label, ["feature"]).select("feature", (F.col("auc") - 0.5).alias("strength"))
    else:
        found = spearman(long, "value", label, ["feature"]).select("feature", F.col("spearman").alias("strength"))
    return found.withColumn("sign", F.when(F.col("strength") < 0, -1).otherwise(1))


def single_feature(rows: DataFrame, feature: str, sign: int) -> DataFrame:
    """Baseline: one feature, oriented."""
    return rows.withColumn("score", F.lit(float(sign)) * F.col(feature))


def random_scores(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Baseline: a seeded draw by key, the same on every run and partitioning; 0 to 1."""
    return rows.withColumn("score", F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32))


def by_age(rows: DataFrame, day: str, newest: bool = True) -> DataFrame:
    """Baseline: newest or oldest first."""
    return rows.withColumn("score", F.col(day).cast("double") * (1 if newest else -1))


def bootstrap_draws(values: DataFrame, key: str, value: str, draws: int, seed: str = "boot") -> DataFrame:
    """(draw, mean): means of as many picks as there are known values, with replacement.

    Pick i of draw d is the value whose number in ``key`` order is the first 32 bits of md5(seed-d-i) modulo their count; picks are
    rows and meet the values by a join, so no task holds them all."""
    numbered = row_numbers(values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v")), [key], "_number")
    n = numbered.count()
    if not n:
        return numbered.select(F.lit(0).cast("long").alias("draw"), F.col("_v").alias("mean"))
    spark = values.sparkSession
    picks = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("i"))
    text = F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("i").cast("string"))
    picks = picks.select("draw", (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).alias("_number"))
    return picks.join(numbered, "_number").groupBy("draw").agg(F.avg("_v").alias("mean"))


def bootstrap_interval(values: DataFrame, key: str, value: str, draws: int, seed: str = "boot") -> DataFrame:
    """(mean, low, high, n) of a mean over cohorts with its 95 % interval."""
    told = values.agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("n"))
    drawn = bootstrap_draws(values, key, value, draws, seed).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return told.crossJoin(drawn).select("mean", "low", "high", "n")


def paired_bootstrap(values: DataFrame, key: str, a: str, b: str, draws: int, seed: str = "boot") -> DataFrame:
    """(delta, low, high, p_better, n): the mean difference a - b over cohorts where both are known, its interval, and the share of draws above 0."""
    diff = values.select(key, (F.col(a) - F.col(b)).alias("_d"))
    told = diff.agg(F.avg("_d").alias("delta"), F.count("_d").alias("n"))
    drawn = bootstrap_draws(diff, key, "_d", draws, seed)
    drawn = drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("p_better"))
    return told.crossJoin(drawn).select("delta", "low", "high", "p_better", "n")


def tier_agreement(a: DataFrame, b: DataFrame, key: str, tier: str, by: list[str]) -> DataFrame:
    """(by, n, same): how many rows two rankings put in the same tier; rows that one of them lacks count as different."""
    x = a.select(*by, key, F.col(tier).alias("_a"))
    y = b.select(*by, key, F.col(tier).alias("_b"))
    return x.join(y, [*by, key], "full_outer").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("same"))


def resampled(rows: DataFrame, label: str, key: str, replicas: int, seed: str = "bag") -> DataFrame:
    """``rows`` as often as each of ``replicas`` draws them, with ``replica``: positives and the rest are drawn apart, each about as many as there are.

    A row's draws are Poisson with mean 1 from a hash of replica and key, the limit of drawing with replacement, so no task needs all rows."""
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.col(label).cast("string"), F.col("replica").cast("string"), F.col(key).cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
    levels, total, term = [], 0.0, 0.36787944117144233  # exp(-1)
    for i in range(1, 9):
        total += term
        levels.append(total)
        term /= i
    times = reduce(lambda x, y: x + y, [(u >= level).cast("int") for level in levels])
    drawn = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("_times", times)
    return drawn.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def bagged(rows: DataFrame, fit: Callable, label: str, key: str, new: DataFrame, by: list[str], replicas: int = 25, seed: str = "bag") -> DataFrame:
    """(by, key, score, spread) of ``new``: mean and deviation of normalised ranks over models of resampled rows.

    Ranks are averaged and not scores, so one unstable model moves little. The models are few and fitted one by one."""
    drawn = resampled(rows, label, key, replicas, seed)
    scored = [fit(drawn.where(F.col("replica") == r).drop("replica"))(new).select(*by, key, "score", F.lit(r).alias("replica")) for r in range(replicas)]
    every = reduce(DataFrame.unionByName, scored)
    return share_rank(every, "score", ["replica", *by], "_rank").groupBy(*by, key).agg(F.avg("_rank").alias("score"), F.stddev_pop("_rank").alias("spread"))


def forward_selection(features: list[str], measure: Callable[[list[str]], float], most: int, least_gain: float = 0.0) -> list[tuple[str, float]]:
    """Features in the order taken, each with the measure reached: each step adds the one that raises ``measure`` most, ties to the first
    in the list, until none raises it by more than ``least_gain``. ``measure`` runs on folds that the final test doesn't use."""
    taken: list[tuple[str, float]] = []
    best = float("-inf")
    while len(taken) < most:
        tried = [(measure([*[t[0] for t in taken], f]), f) for f in features if f not in {t[0] for t in taken}]
        if not tried:
            break
        top = max(tried, key=lambda x: x[0])
        if top[0] <= best + least_gain:
            break
        best = top[0]
        taken.append((top[1], best))
    return taken


def leave_one_feature_out(features: list[str], measure: Callable[[list[str]], float]) -> list[tuple[str, float]]:
    """(feature, loss): what the measure loses without each feature, largest loss first."""
    whole = measure(features)
    return sorted(((f, whole - measure([x for x in features if x != f])) for f in features), key=lambda x: -x[1])


def sweep(settings: list[dict], run: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``run(**setting)`` for each of the stated settings, with the setting's values as columns."""
    def tagged(setting: dict) -> DataFrame:
        return run(**setting).withColumns({name: F.lit(value) for name, value in setting.items()})

    return reduce(DataFrame.unionByName, [tagged(s) for s in settings])


def missing_authors(rows: DataFrame, features: dict[str, float], key: str, share: float, seed: str) -> DataFrame:
    """``rows`` where a seeded ``share`` of keys have the author features replaced by the values of an unknown author."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    return rows.withColumns({f: F.when(draw < share, F.lit(v)).otherwise(F.col(f)) for f, v in features.items()})


def outsider_recall(scores: DataFrame, score: str, hit: str, outsider: str, by: list[str]) -> DataFrame:
    """(by, outsider, hits, percentile): the median percentile that hits reach, for outsiders and the rest."""
    marked = percentile_rank(scores, score, by, "_p").where(F.col(hit) == 1)
    counted = marked.groupBy(*by, outsider).agg(F.count("*").alias("hits"))
    return met(counted, quantiles(marked, "_p", [*by, outsider], {"percentile": 0.5}), [*by, outsider])


def boards(rows: DataFrame, month: str, width: int, months: list[int]) -> DataFrame:
    """Rows with ``board``: each board of ``months`` has the papers of the ``width`` months that end with it, and their ``age``."""
    ends = F.array(*[F.lit(m) for m in months])
    mine = F.filter(ends, lambda m: (m >= F.col(month)) & (m < F.col(month) + width))
    return rows.withColumn("board", F.explode(mine)).withColumn("age", F.col("board") - F.col(month))


def position_fade(rows: DataFrame, order: list[Column], by: list[str], first: float = 1.0, last: float = 0.2) -> DataFrame:
    """Adds ``fade``: from ``first`` to ``last`` in equal steps by place in ``order``; a row alone gets ``first``."""
    placed = numbered(rows, by, order, "_place", "_n")
    return placed.withColumn("fade", F.lit(first) - (first - last) * (F.col("_place") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_place", "_n")


def evaluable_months(rows: DataFrame, month: str, warmup: int, horizon: int, months: int) -> DataFrame:
    """Rows of months that have enough history before them and a whole horizon after."""
    return rows.where((F.col(month) >= warmup) & (F.col(month) < months - horizon))


def kendall(rows: DataFrame, x: str, y: str, key: str, by: list[str], block: int = 2_000) -> DataFrame:
    """(by, tau): Kendall's tau-b over all pairs of each cohort.

    Rows are numbered within the cohort by (x, y) and cut into blocks. Pairs within a block, and pairs of two blocks, are counted in
    tasks of their own from the block's numbers alone, by sorting and searching, so no pairs are formed; ties come from counts of values."""
    import numpy as np
    import pyarrow as pa

    names = [f"_by{i}" for i in range(len(by))]
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(key).alias("_key"))
    w = Window.partitionBy(*names)
    placed = own.withColumn("_block", F.floor((F.row_number().over(w.orderBy("_x", "_y", "_key")) - 1) / block).cast("int"))
    blocks = placed.groupBy(*names).agg((F.max("_block") + 1).alias("_blocks"))
    dealt = placed.join(blocks, names).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select(*names).schema) + ", s double"

    def count(table: pa.Table) -> pa.Table:
        xs, ys, of = table["_x"].to_numpy(), table["_y"].to_numpy(), table["_block"].to_numpy()
        low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
        total = 0
        if low == high:
            a, b = np.sign(xs[:, None] - xs[None, :]), np.sign(ys[:, None] - ys[None, :])
            total = float((a * b).sum()) / 2
        else:
            ax, ay, bx, by_ = xs[of == low], ys[of == low], xs[of == high], ys[of == high]
            top = ax.max()  # of equal x only the border's can be in both blocks
            for px, py in ((bx > top, ay), (bx == top, ay[ax < top])):
                inner, order = by_[px], np.sort(py)
                total += int(np.searchsorted(order, inner, "left").sum() - (len(order) - np.searchsorted(order, inner, "right")).sum())
        first = table.slice(0, 1).select(names)
        return first.append_column("s", pa.array([float(total)]))

    signs = dealt.groupBy(*names, "_low", "_high").applyInArrow(count, schema).groupBy(*names).agg(F.sum("s").alias("_s"))

    def tied(*columns: str) -> DataFrame:
        return own.groupBy(*names, *columns).agg(F.count("*").alias("_t")).groupBy(*names).agg(F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias("_tied"))

    pairs = own.groupBy(*names).agg((F.count("*") * (F.count("*") - 1) / 2).alias("_pairs"))
    joined = pairs.join(signs, names).join(tied("_x").withColumnRenamed("_tied", "_tx"), names).join(tied("_y").withColumnRenamed("_tied", "_ty"), names)
    tau = F.try_divide(F.col("_s"), F.sqrt((F.col("_pairs") - F.col("_tx")) * (F.col("_pairs") - F.col("_ty"))))
    return joined.select(*[F.col(n).alias(b) for b, n in zip(by, names, strict=True)], tau.alias("tau"))
