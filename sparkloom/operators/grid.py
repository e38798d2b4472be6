"""Two-dimensional maps: quantile edges, bins, density, viewport queries and the latest feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordering import selected

TRIM = (0.005, 0.995)
MARGIN = 0.03
LEAST_BINS = 8


def edges(points: DataFrame, x: str = "x", y: str = "y", trim: tuple[float, float] = TRIM, margin: float = MARGIN) -> DataFrame:
    """One row x_lo, x_hi, y_lo, y_hi: interpolated quantiles widened by a margin; a constant axis gets a tiny span, an empty one nulls.

    The quantiles are selected by counting (see ``ordering.selected``), so no task gets all points."""
    q = selected(points, {f"{n}_{e}": (c, p) for c, n in ((x, "x"), (y, "y")) for p, e in zip(trim, ("lo", "hi"), strict=True)})
    ends: dict[str, float | None] = {}
    for n in ("x", "y"):
        low, high = q[f"{n}_lo"], q[f"{n}_hi"]
        span = None if low is None else max(high - low, 1e-6)
        ends |= {f"{n}_lo": span and low - margin * span, f"{n}_hi": span and low + (1 + margin) * span}
    return points.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in ends.items()])


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    place = F.floor((value - low) / ((high - low) / bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int")


def binned(points: DataFrame, grid: DataFrame, bins: int) -> DataFrame:
    """``points`` with bin_x and bin_y; the grid is one row, so broadcasting it is bounded."""
    n = max(bins, LEAST_BINS)
    both = points.crossJoin(F.broadcast(grid))
    return both.withColumn("bin_x", bin_of(F.col("x"), F.col("x_lo"), F.col("x_hi"), n)).withColumn("bin_y", bin_of(F.col("y"), F.col("y_lo"), F.col("y_hi"), n))


def whole_edges(points: DataFrame) -> DataFrame:
    """One row of the grid's ends that holds all points: their least and largest, without a margin; a span of 0 counts as 1e-6."""
    ends = points.agg(*[f(a).alias(f"{a}_{n}") for a in ("x", "y") for n, f in (("lo", F.min), ("top", F.max))])
    return ends.select(*[c for a in ("x", "y") for c in (F.col(f"{a}_lo"), F.greatest(F.col(f"{a}_top"), F.col(f"{a}_lo") + 1e-6).alias(f"{a}_hi"))])


def density(points: DataFrame, grid: DataFrame, bins: int) -> DataFrame:
    """Counts and centres of cells that have points."""
    n = max(bins, LEAST_BINS)
    centre = lambda b, a: F.first(F.col(f"{a}_lo") + (F.col(b) + 0.5) * (F.col(f"{a}_hi") - F.col(f"{a}_lo")) / n)
    return binned(points, grid, n).groupBy("bin_x", "bin_y").agg(F.count("*").alias("doc_count"), centre("bin_x", "x").alias("x_center"), centre("bin_y", "y").alias("y_center"))


def latest_feed(points: DataFrame, cells: DataFrame, moment: str, window_days: int) -> DataFrame:
    """Rows of the last days with recency, novelty (rare cells) and their blend.

    The newest moment and the novelty's ends are one-row aggregates, not windows over all rows."""
    days = max(window_days, 1)
    dated = points.where(F.col(moment).isNotNull())
    newest = dated.agg(F.max(moment).alias("_newest"))
    recent = dated.crossJoin(F.broadcast(newest)).where(F.col(moment) >= F.col("_newest") - F.make_dt_interval(F.lit(days)))
    raw = recent.join(cells.select("bin_x", "bin_y", "doc_count"), ["bin_x", "bin_y"], "left").withColumn("_raw", 1 / F.greatest(F.coalesce("doc_count", F.lit(1)), F.lit(1)))
    ends = raw.agg(F.min("_raw").alias("_least"), F.max("_raw").alias("_most"))
    age = (F.unix_timestamp("_newest") - F.unix_timestamp(moment)) / 86400.0
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    scored = raw.crossJoin(F.broadcast(ends)).withColumn("recency_score", clip(1 - age / days))
    scored = scored.withColumn("novelty_score", F.when(F.col("_most") <= F.col("_least"), 0.0).otherwise((F.col("_raw") - F.col("_least")) / (F.col("_most") - F.col("_least"))))
    return scored.withColumn("score", clip(0.6 * F.col("recency_score") + 0.4 * F.col("novelty_score"))).drop("_newest", "_raw", "_least", "_most", "doc_count")


def viewport(points: DataFrame, x: tuple | None, y: tuple | None, years: tuple | None, needle: str = "", text: tuple[str, ...] = ("title",)) -> DataFrame:
    """Points in the ranges (each in any order of its ends) whose text holds ``needle`` literally; ranges reach the scan."""
    found = points
    for column, bounds in (("x", x), ("y", y), ("year", years)):
        if bounds is not None:
            found = found.where(F.col(column).between(min(bounds), max(bounds)))
    if needle.strip():
        wanted = needle.strip().lower()
        test = F.lit(False)
        for c in text:
            test = test | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
        found = found.where(test)
    return found


def map_mode(has_viewport: bool, has_filter: bool, found: int, cap: int) -> str:
    """What the map shows: a preview, exact papers, or advice to zoom."""
    if not has_viewport and not has_filter:
        return "Global preview" if found else "Idle"
    if not found:
        return "No exact papers"
    if found > cap:
        return "Zoom for focus"
    return "Search focus" if has_filter else "Exact paper view"


def tail_order(score: str, moment: str) -> list[Column]:
    return [F.col(score).desc(), F.col(moment).desc()]


