"""Training samples: anchors with targets, look-back lists, calendars ahead with what isn't known masked, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import nearest_day


def anchors(values: DataFrame, dates: DataFrame, day: str, horizons: list[int], lookback: int) -> DataFrame:
    """Days that may be anchors: with a value, a target one horizon on, and a full look-back of dates.

    values: (day, value), dates: (day), one row a day. Rows: day, window (its last `lookback` dates, the day last), and for each
    horizon h change_h, the target less the anchor's value (0 without one), and mask_h. Targets are the nearest days' values.
    """
    back = Window.orderBy(day).rowsBetween(1 - lookback, 0)  # a row a calendar day
    window = F.collect_list(day).over(back)
    out = dates.select(day, window.alias("window")).where(F.size("window") == lookback).join(values, day)
    for h in horizons:
        target = nearest_day(values, values, day, h).select(day, F.col("target_value").alias("_t"))
        change = {f"change_{h}": F.coalesce(F.col("_t") - F.col("value"), F.lit(0.0)), f"mask_{h}": F.col("_t").isNotNull().cast("double")}
        out = out.join(target, day, "left").withColumns(change).drop("_t")
    return out.where(F.col(f"mask_{horizons[0]}") == 1)


def calendar(anchor_days: DataFrame, events: DataFrame, day: str, back: int, ahead: int) -> DataFrame:
    """Events of the `back` days up to each anchor and of the `ahead` days after it: anchor, days_until, is_future, and the event's columns.

    Each anchor asks for its days by equality.
    """
    asked = anchor_days.select(F.col(day).alias("anchor"), F.explode(F.sequence(F.lit(1 - back), F.lit(ahead))).alias("days_until"))
    asked = asked.withColumns({day: F.date_add("anchor", F.col("days_until")), "is_future": F.col("days_until") > 0})
    return asked.join(events, day)


def masked_vector(columns: list[str], hidden: set[str], is_future: Column) -> Column:
    """The columns as one vector, those in hidden 0 for what lies ahead."""
    return F.array(*[F.when(is_future, 0.0).otherwise(F.col(c).cast("double")) if c in hidden else F.col(c).cast("double") for c in columns])


def padded(vectors: Column, length: Column, width: int) -> tuple[Column, Column]:
    """A list of vectors filled up with zero vectors to length, and its mask of ones and zeros."""
    zero, more = F.array_repeat(F.lit(0.0), width), F.greatest(length - F.size(vectors), F.lit(0))
    return F.concat(vectors, F.array_repeat(zero, more)), F.concat(F.transform(vectors, lambda v: F.lit(1.0)), F.array_repeat(F.lit(0.0), more))
