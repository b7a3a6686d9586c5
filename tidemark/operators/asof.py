"""Joins in time: as-of both ways, nearest date, intervals, state at a date, positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import matched, numbered


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], forward: bool = False, cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the values of the latest right row at or before ts (forward: the first at or after), null where there is none.

    One union and one window, a sort by key and time; keys split the work. Where keys are few and their rows many, cell splits
    it further: a function of ts that never falls as ts grows, such as its day. The window then runs within a cell, and the last
    right row of the cells before comes from one row a cell. Right rows of one key and time: the largest values.
    """
    side = right.select(*keys, ts, F.struct(ts, *values).alias("_right"), F.lit(0).alias("_side"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (*keys, ts)])
    rows = left.withColumns({"_right": F.lit(None).cast(side.schema["_right"].dataType), "_side": F.lit(1)}).unionByName(side)
    way = F.desc if forward else F.asc
    rows = rows.withColumn("_cell", cell(F.col(ts)) if cell else F.lit(0))
    order = Window.partitionBy(*keys, "_cell").orderBy(way(ts), "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(order))
    if cell:
        edge = F.min_by if forward else F.max_by
        carried = Window.partitionBy(*keys).orderBy(way("_cell")).rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys, "_cell").agg(edge("_right", F.when(F.col("_right").isNotNull(), F.col(ts))).alias("_end"))
        ends = ends.select(*keys, "_cell", F.last("_end", ignorenulls=True).over(carried).alias("_end"))
        found = matched(found.where("_side = 1"), ends, [*keys, "_cell"]).withColumn("_found", F.coalesce("_found", "_end"))
    rows = found.where("_side = 1")
    return rows.select(*left.columns, F.col(f"_found.{ts}").alias(f"right_{ts}"), *[F.col(f"_found.{v}").alias(v) for v in values])


def nearest_day(anchors: DataFrame, targets: DataFrame, day: str, horizon: int, reach: int = 9) -> DataFrame:
    """anchors with the target nearest to day + horizon: that day, then +1, -1, +2, -2 ... +-reach; a later day wins a tie.

    Each anchor asks for 2 * reach + 1 days by equality; no range join.
    """
    offsets = [0] + [s * k for k in range(1, reach + 1) for s in (1, -1)]
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)]))
    rows = anchors.select("*", asked.alias("_a")).withColumn("_day", F.date_add(day, F.lit(horizon) + F.col("_a.offset")))
    hits = rows.join(targets.select(F.col(day).alias("_day"), F.col("value").alias("_value")), "_day")
    found = hits.groupBy(day).agg(F.min_by(F.struct("_day", "_value"), "_a.rank").alias("_f"))
    return anchors.join(found, day, "left").select(*anchors.columns, F.col("_f._day").alias("target_day"), F.col("_f._value").alias("target_value"))


def within(tokens: DataFrame, segments: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """tokens in the closed interval [start, end] of a segment of their keys and day; those between segments go."""
    spread = segments.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    return tokens.withColumn("_day", F.to_date(ts)).join(spread, [*keys, "_day"]).where(F.col(ts).between(F.col("start"), F.col("end"))).drop("_day")


def state_at(dates: DataFrame, filings: DataFrame, key: str, day: str, filed: str, valid_days: int = 180) -> DataFrame:
    """For each date the latest filing of each key, no older than valid_days: filings hold until the next one or their age.

    The intervals meet the dates by month, an equality; only then by day.
    """
    w = Window.partitionBy(key).orderBy(filed)
    until = F.least(F.coalesce(F.date_sub(F.lead(filed).over(w), 1), F.date_add(filed, valid_days)), F.date_add(filed, valid_days))
    held = filings.withColumn("_until", until)
    held = held.withColumn("_month", F.explode(F.sequence(F.trunc(filed, "MM"), F.trunc("_until", "MM"), F.expr("interval 1 month"))))
    rows = dates.withColumn("_month", F.trunc(day, "MM")).join(held, "_month")
    return rows.where((F.col(day) >= F.col(filed)) & (F.col(day) <= F.col("_until"))).drop("_month", "_until")


def last_end(tokens: DataFrame, segments: DataFrame, keys: list[str], ts: str, segment: str, cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """tokens with the segment that they fall in: from its start to its end, both included; segment 0 has no start.

    segments: keys, segment, start, end, in order and apart. A token asks for the first end at or after it, an as-of join.
    """
    ends = segments.select(*keys, F.col("end").alias(ts), segment, "start")
    found = asof(tokens, ends, keys, ts, [segment, "start"], forward=True, cell=cell)
    return found.where((F.col(segment) == 0) | (F.col(ts) >= F.col("start"))).drop("start", f"right_{ts}")


def by_position(left: DataFrame, right: DataFrame, keys: list[str], order_left: list[str], order_right: list[str], values: list[str], cells: tuple[Column, Column]) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right; 0 where the right is shorter.

    cells: for either side a column that never falls along its order, by whose values the counting is split.
    """
    a = numbered(left.withColumn("_cell", cells[0]), keys, "_cell", order_left, "nth").drop("_cell")
    b = numbered(right.withColumn("_cell", cells[1]), keys, "_cell", order_right, "nth").select(*keys, "nth", *values)
    return a.join(b, [*keys, "nth"], "left").withColumns({v: F.coalesce(F.col(v), F.lit(0.0)) for v in values})
