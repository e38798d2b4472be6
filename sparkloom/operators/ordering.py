"""Order statistics of cohorts of any size: no task ever sees a whole cohort, and no key's ties meet in one task.

``value_places`` counts rows by cohort and value (ties melt in the partial aggregation), deals the distinct values out by range, and adds up
ranges within each cohort. Ranks, percentiles, quantiles, AUC and correlations of ranks follow from those counts. ``numbered`` does the same for rows
in an order. ``selected`` finds quantiles of whole columns without any shuffle of values: a bounded sketch brackets each, counts tell how many
lie below, and only the bracket goes on.

Nulls are a value of their own and come first, as Spark sorts them; NaN comes last; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import checkpoint_dir

#: Rank accuracy of the sketches that bracket quantiles; their size is in proportion to it.
ACCURACY = 10_000
#: Distinct values in a bracket that are counted at last.
HELD = 10_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` with ``right``'s columns of the same names after ``_of_``."""
    found = F.lit(True)
    for k in keys:
        found = found & left[k].eqNullSafe(right[f"_of_{k}"])
    return found


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row a key; a hot key's rows stay apart, as Spark splits a skewed left side."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return left.join(renamed, same(left, renamed, keys), "left").drop(*[f"_of_{k}" for k in keys])


def _ranged(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` dealt out by range of cohort and order, with ``_range``. The range is stored with its rows: planned anew, bounds may differ from one
    branch to the other."""
    checkpoint_dir(rows.sparkSession)
    return rows.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()).checkpoint()


def _upto(spread: DataFrame, by: list[str], n: Column) -> DataFrame:
    """(by, _range, _ahead, n_total): what earlier ranges of the cohort hold, and the cohort; a row a range and one more a cohort at most."""
    sums = spread.groupBy(*by, "_range").agg(F.sum(n).cast("long").alias("_range_n"))
    whole = Window.partitionBy(*by)
    ahead = F.sum("_range_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*by, "_range", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_range_n").over(whole).alias("n_total"))


def value_places(rows: DataFrame, value: str, by: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """(by, value, n_equal, n_before, n_total) of each cohort's distinct values, with ``more`` aggregates of their rows."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n_equal"), *[c.alias(name) for name, c in (more or {}).items()])
    spread = _ranged(counted, by, [F.col(value)])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("_inside", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
    joined = met(placed, _upto(spread, by, F.col("n_equal")), [*by, "_range"])
    return joined.withColumn("n_before", F.col("_ahead") + F.col("_inside")).drop("_range", "_inside", "_ahead")


def rank_of(descending: bool = False) -> Column:
    """Tie-averaged rank from 1 out of ``value_places``."""
    before = F.col("n_total") - F.col("n_before") - F.col("n_equal") if descending else F.col("n_before")
    return before + (F.col("n_equal") + 1) / 2


def ranked(rows: DataFrame, value: str, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """``rows`` with ``columns`` made of their value's n_equal, n_before and n_total."""
    places = value_places(rows, value, by)
    told = places.select(*by, value, *[c.alias(name) for name, c in columns.items()])
    return met(rows, told, [*by, value])


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order`` within the cohort, and the cohort's size as ``total``.

    A range holds what is equal in all of ``order``, so it should end with a key."""
    spread = _ranged(rows, by, order)
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    joined = met(spread.withColumn("_inside", inside), _upto(spread, by, F.lit(1)), [*by, "_range"])
    found = joined.withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_range", "_inside", "_ahead")
    return found.withColumnRenamed("n_total", total) if total else found.drop("n_total")


def lagged(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``value`` of the row before in ``order`` within the cohort; null for the first."""
    spread = _ranged(rows, by, order)
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    own = F.struct(F.col(value).alias("v"))  # a null before a row differs from no row
    placed = spread.withColumn("_inside", F.row_number().over(w)).withColumn("_before", F.lag(own).over(w))
    ends = placed.groupBy(*by, "_range").agg(F.max_by(own, "_inside").alias("_end"))
    ends = ends.select(*by, "_range", F.lag("_end").over(Window.partitionBy(*by).orderBy("_range")).alias("_end"))  # a row a range
    joined = met(placed, ends, [*by, "_range"])
    return joined.withColumn(name, F.coalesce("_before", "_end")["v"]).drop("_range", "_inside", "_before", "_end")


def carried(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the last known ``value`` up to each row in ``order`` within the cohort."""
    spread = _ranged(rows, by, order)
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.withColumn("_own", F.last(value, ignorenulls=True).over(w)).withColumn("_inside", F.count("*").over(w))
    ends = placed.groupBy(*by, "_range").agg(F.max_by("_own", "_inside").alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    joined = met(placed, ends.select(*by, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_end")), [*by, "_range"])
    return joined.withColumn(name, F.coalesce("_own", "_end")).drop("_range", "_own", "_inside", "_end")


def quantiles(rows: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, names of ``wanted``): interpolated quantiles of the known values of each cohort; cohorts without any don't come."""
    places = value_places(rows.where(F.col(value).isNotNull()), value, by)
    parts = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("n_total") - 1)
        covers = lambda place: (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n_equal"))
        low, high = F.max(F.when(covers(F.floor(at)), F.col(value))), F.max(F.when(covers(F.ceil(at)), F.col(value)))
        share = F.max(at - F.floor(at))
        parts.append((low * (1 - share) + high * share).alias(name))
    return places.groupBy(*by).agg(*parts)


def selected(rows: DataFrame, wanted: dict[str, tuple[str, float]], accuracy: int = ACCURACY, held: int = HELD) -> dict[str, float | None]:
    """{name: quantile} of whole columns from {name: (column, share)}: exact, interpolated, nulls and NaN left out; None where nothing is known.

    Every order statistic that is needed has a bracket of its own, open at both ends. A round is two aggregations over the rows in any bracket: a
    sketch proposes two values close to the statistic, then counts below, at and between them tell whether it is one of the two or where it lies. A round
    leaves about 4 / ``accuracy`` of a bracket's rows, however its values are tied, until few distinct values are left, which are counted out."""
    names = sorted({c for c, _ in wanted.values()})
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = rows.select(*[known(c).alias(c) for c in names])
    sizes = rows.agg(*[F.count(c).alias(c) for c in names]).first()
    asked = {(c, f(share * (sizes[c] - 1))) for c, share in wanted.values() if sizes[c] for f in (math.floor, math.ceil)}
    found: dict[tuple[str, int], float] = {}
    brackets = [_Bracket(c, place, None, None, 0, sizes[c]) for c, place in sorted(asked)]
    while brackets:
        told = rows.where(_any(brackets)).agg(*[x for i, b in enumerate(brackets) for x in b.sketched(i, accuracy)]).first()
        few = [b for i, b in enumerate(brackets) if told[f"distinct_{i}"] <= held // 2]
        found |= {(b.column, b.place): b.counted_out(rows) for b in few}
        proposed = [(b, *told[f"ends_{i}"]) for i, b in enumerate(brackets) if b not in few]
        if not proposed:
            break
        counts = rows.where(_any([b for b, _, _ in proposed])).agg(*[x for i, (b, low, high) in enumerate(proposed) for x in b.counts(i, low, high)]).first()
        brackets = []
        for i, (b, low, high) in enumerate(proposed):
            value, rest = b.narrowed(low, high, *[counts[f"{kind}_{i}"] for kind in ("below", "at_low", "between", "at_high")])
            if rest is None:
                found[b.column, b.place] = value
            else:
                brackets.append(rest)

    def value(c: str, share: float) -> float | None:
        if not sizes[c]:
            return None
        at = share * (sizes[c] - 1)
        low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
        return low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))

    return {name: value(c, share) for name, (c, share) in wanted.items()}


@dataclass(frozen=True)
class _Bracket:
    """The value at ``place`` (from 0) of a column lies between ``low`` and ``high``, both excluded (None: no end); ``below`` values are at most ``low``."""

    column: str
    place: int
    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self) -> Column:
        value, found = F.col(self.column), F.col(self.column).isNotNull()
        if self.low is not None:
            found = found & (value > F.lit(self.low))
        return found if self.high is None else found & (value < F.lit(self.high))

    def sketched(self, i: int, accuracy: int) -> list[Column]:
        value = F.when(self.holds(), F.col(self.column))
        ends = [max(0.0, (self.place - self.below) / self.inside - 2 / accuracy), min(1.0, (self.place + 1 - self.below) / self.inside + 2 / accuracy)]
        return [F.percentile_approx(value, ends, accuracy).alias(f"ends_{i}"), F.approx_count_distinct(value).alias(f"distinct_{i}")]

    def counts(self, i: int, low: float, high: float) -> list[Column]:
        value, count = F.col(self.column), lambda c: F.count_if(self.holds() & c)
        return [
            count(value < F.lit(low)).alias(f"below_{i}"),
            count(value == F.lit(low)).alias(f"at_low_{i}"),
            count((value > F.lit(low)) & (value < F.lit(high))).alias(f"between_{i}"),
            count((value == F.lit(high)) & F.lit(low < high)).alias(f"at_high_{i}"),
        ]

    def narrowed(self, low: float, high: float, below: int, at_low: int, between: int, at_high: int) -> tuple[float | None, _Bracket | None]:
        """The value, or a narrower bracket: between the proposed ends or, where the sketch missed, beside them."""
        place = self.place - self.below
        if place < below:
            return None, _Bracket(self.column, self.place, self.low, low, self.below, below)
        if place < below + at_low:
            return low, None
        if place < below + at_low + between:
            return None, _Bracket(self.column, self.place, low, high, self.below + below + at_low, between)
        upto = below + at_low + between + at_high
        if place < upto:
            return high, None
        return None, _Bracket(self.column, self.place, high, self.high, self.below + upto, self.inside - upto)

    def counted_out(self, rows: DataFrame) -> float:
        """The value from counts of the bracket's distinct values, which are few enough for the driver."""
        seen = self.below
        for value, n in rows.where(self.holds()).groupBy(self.column).count().orderBy(self.column).collect():
            seen += n
            if self.place < seen:
                return value
        raise ValueError(f"{self.column} has changed while it was read")


def _any(brackets: list[_Bracket]) -> Column:
    found = F.lit(False)
    for b in brackets:
        found = found | b.holds()
    return found


def pooled(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Neighbouring (low, high, weight, sum) blocks in order, pooled until means rise."""
    found: list[tuple[float, float, float, float]] = []
    for low, high, weight, total in blocks:
        while found and found[-1][3] * weight >= total * found[-1][2]:
            before = found.pop()
            low, weight, total = before[0], before[2] + weight, before[3] + total
        found.append((low, high, weight, total))
    return found


def isotonic(rows: DataFrame, value: str, label: str, together: int = 16) -> DataFrame:
    """(low, high, weight, fitted): the least-squares fit of ``label`` that doesn't fall with ``value``, a row a level.

    Values are counted, dealt out by range and pooled within their ranges; what stays of ``together`` neighbouring ranges is pooled again, and so on. Pooling in parts
    and then across gives what pooling at once does, and each round goes on with blocks only; the last holds as many as the fit has levels. Rows with an unknown value or
    label don't count."""
    import pyarrow as pa

    checkpoint_dir(rows.sparkSession)
    known = rows.select(F.col(value).cast("double").alias("low"), F.col(label).cast("double").alias("_y")).where("low IS NOT NULL AND NOT isnan(low) AND _y IS NOT NULL AND NOT isnan(_y)")
    counted = known.groupBy("low").agg(F.count("*").cast("double").alias("weight"), F.sum("_y").alias("total"))
    blocks = _ranged(counted.select("low", F.col("low").alias("high"), "weight", "total"), [], [F.col("low")])

    def pool(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        found = pooled(list(zip(*[table[c].to_pylist() for c in ("low", "high", "weight", "total")], strict=True)))
        columns = [pa.array([b[i] for b in found], pa.float64()) for i in range(4)]
        return pa.table([*columns, pa.array([table["_range"][0].as_py()] * len(found), pa.int32())], names=["low", "high", "weight", "total", "_range"])

    while True:
        blocks = blocks.groupBy("_range").applyInArrow(pool, "low double, high double, weight double, total double, _range int").checkpoint()
        if not blocks.agg(F.max("_range")).first()[0]:
            return blocks.select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("fitted"))
        blocks = blocks.withColumn("_range", F.floor(F.col("_range") / together).cast("int"))


def fitted(rows: DataFrame, value: str, levels: DataFrame) -> DataFrame:
    """(value, fitted) of the distinct known values of ``rows`` by the levels of ``isotonic``: that of the last level which begins at or below."""
    asked = rows.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").distinct().select("_v", F.lit(None).cast("double").alias("_level"))
    both = levels.select(F.col("low").alias("_v"), F.col("fitted").alias("_level")).union(asked)
    told = carried(both.withColumn("_asked", F.col("_level").isNull()), [], [F.col("_v"), F.col("_asked")], "_level", "fitted")
    return told.where("_asked").select(F.col("_v").alias(value), "fitted")
