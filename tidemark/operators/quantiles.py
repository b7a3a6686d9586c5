"""Exact quantiles of groups of any size: counts below candidate values, refined until each rank is pinned to a value.

Each rank starts in the interval of all values. A sketch of the values inside an interval proposes two of them on either side of the
rank; exact counts of the values below and at both either pin the rank or leave it in a smaller interval. Sketches
only choose candidates, so the results are exact whatever their error. Ranks whose interval holds few values are read off those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .ordered import matched

#: Values that are sorted at once, and the steps that a sketch tells apart.
FEW, STEPS = 65_536, 1000
#: Ranks in question up to which the intervals are sent to every task.
SENT = 100_000


def _inside(rows: DataFrame, intervals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Each row with each interval of its group that it lies in; how="left_semi": the rows that lie in one."""
    named = intervals.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    test = F.expr("(_low IS NULL OR _x > _low) AND (_high IS NULL OR _x < _high)")
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return rows.join(named, test, how).drop(*[f"_on_{k}" for k in keys])


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str], sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One round for targets: keys, _rank (from 0, of all values), _low, _high (exclusive), _below (values up to _low), _many (values inside)."""
    bounds = ["_low", "_high"]
    intervals = targets.select(*keys, *bounds).distinct()
    sketch = F.percentile_approx("_x", [i / STEPS for i in range(STEPS + 1)], 10 * STEPS)
    sketches = _inside(rows, sent(intervals), keys).groupBy(*keys, *bounds).agg(sketch.alias("_sketch"))
    nth = F.floor((F.col("_rank") - F.col("_below")) * STEPS / F.col("_many")).cast("int")
    near = matched(targets, sketches, [*keys, *bounds])
    near = near.withColumns({"_c1": F.col("_sketch")[F.greatest(nth - 1, F.lit(0))], "_c2": F.col("_sketch")[F.least(nth + 2, F.lit(STEPS))]}).drop("_sketch")
    tests = {"_n1": "_x < _c1", "_e1": "_x = _c1", "_n2": "_x < _c2", "_e2": "_x = _c2"}
    counts = _inside(rows, sent(near), keys).groupBy(*near.columns).agg(*[F.count_if(F.expr(t)).alias(n) for n, t in tests.items()])
    r = F.col("_rank") - F.col("_below")
    places = [r < F.col("_n1"), r < F.col("_n1") + F.col("_e1"), r < F.col("_n2"), r < F.col("_n2") + F.col("_e2")]

    def by_place(*values):
        out = F.when(places[0], values[0])
        for p, v in zip(places[1:], values[1:4], strict=True):
            out = out.when(p, v)
        return out.otherwise(values[4])

    c, none = F.col, F.lit(None).cast("double")
    return counts.select(
        *keys, "_rank", by_place(c("_low"), none, c("_c1"), none, c("_c2")).alias("_low"), by_place(c("_c1"), none, c("_c2"), none, c("_high")).alias("_high"),
        by_place(c("_below"), c("_below"), c("_below") + c("_n1") + c("_e1"), c("_below"), c("_below") + c("_n2") + c("_e2")).alias("_below"),
        by_place(c("_n1"), F.lit(0), c("_n2") - c("_n1") - c("_e1"), F.lit(0), c("_many") - c("_n2") - c("_e2")).alias("_many"),
        by_place(none, c("_c1"), none, c("_c2"), none).alias("_value"),
    )


def exact_quantiles(df: DataFrame, keys: list[str], x: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """A row for each group that has a value: keys, and a double for each entry of `wanted` (name: share from 0 to 1), the value at that
    share of the ranks, between two values linearly. Nulls don't count; a NaN is larger than every number.

    Groups of up to `few` values are sorted as they are; no buffer holds more, however large a group is and however often a value
    recurs. Each round reads the values still in question twice and leaves about a three-hundredth of them.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL")
    sizes = kept(rows.groupBy(*keys).agg(F.count("*").alias("_many")))
    large, small = sizes.where(F.col("_many") > few), sizes.where(F.col("_many") <= few)
    named = [F.percentile("_x", p).alias(n) for n, p in wanted.items()]
    if large.isEmpty():
        return rows.groupBy(*keys).agg(*named)
    out = matched(rows, small.select(*keys), keys).groupBy(*keys).agg(*named)
    position = {n: (F.col("_many") - 1) * F.lit(float(p)) for n, p in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(v), F.ceil(v)) for v in position.values()])))
    none = F.lit(None).cast("double")
    targets = large.select(*keys, "_many", F.explode(ranks).alias("_rank"), none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below"))
    sent = F.broadcast if large.count() * 2 * len(wanted) <= SENT else lambda x: x
    pinned, rest = [], rows
    while True:
        found = kept(_narrowed(rest, targets, keys, sent))
        pinned.append(found.where("_value IS NOT NULL").select(*keys, "_rank", "_value"))
        targets = found.where("_value IS NULL").drop("_value")
        # Only what lies in some interval is read again.
        rest = kept(_inside(rest, sent(targets.select(*keys, "_low", "_high").distinct()), keys, "left_semi"))
        close = _inside(rest, sent(targets.where(F.col("_many") <= few)), keys).groupBy(*keys, "_rank", "_below")
        nth = (F.col("_rank") - F.col("_below")).cast("int")
        pinned.append(close.agg(F.sort_array(F.collect_list("_x")).alias("_all")).select(*keys, "_rank", F.col("_all")[nth].alias("_value")))
        targets = targets.where(F.col("_many") > few)
        if targets.isEmpty():
            break
    values = reduce(DataFrame.unionByName, pinned)
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_value")))
    shares = matched(values, large, keys).groupBy(*keys, "_many")
    shares = shares.agg(*[at(side(v)).alias(f"_{s}_{n}") for n, v in position.items() for s, side in (("a", F.floor), ("b", F.ceil))])
    for n, v in position.items():
        shares = shares.withColumn(n, F.when(F.floor(v) == F.ceil(v), F.col(f"_a_{n}")).otherwise((F.ceil(v) - v) * F.col(f"_a_{n}") + (v - F.floor(v)) * F.col(f"_b_{n}")))
    return out.unionByName(shares.select(*keys, *wanted))
