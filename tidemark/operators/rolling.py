"""Row-order windows of one series: lags, rolling and cumulative statistics, fills, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import clip, finite, sigmoid
from .long_series import percentile_rank


def series(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last_rows(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(1 - k, 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def lag_diff(x: Column, k: int, w: WindowSpec, first: float | None = None) -> Column:
    """x less its value k rows before; the first k rows get `first`."""
    d = x - F.lag(x, k).over(w)
    return d if first is None else F.coalesce(d, F.lit(first))


def acceleration(x: Column, k: int, w: WindowSpec) -> Column:
    return x - 2 * F.lag(x, k).over(w) + F.lag(x, 2 * k).over(w)


def pct_change(x: Column, k: int, w: WindowSpec, floor: float | None = None) -> Column:
    before = F.lag(x, k).over(w)
    change = F.try_divide(x - before, before)
    return change if floor is None else F.when(before > floor, change)


def log_return(x: Column, w: WindowSpec) -> Column:
    """Log of the value over the one before; null unless both are over 0 and the result is finite."""
    before = F.lag(x, 1).over(w)
    return finite(F.when((x > 0) & (before > 0), F.ln(x / before)))


def rolling(aggregate: Column, x: Column, k: int, w: WindowSpec, least: int | None = None) -> Column:
    """An aggregate over the last k rows where at least `least` (all k, if not said) have values."""
    frame = last_rows(w, k)
    return F.when(F.count(x).over(frame) >= (k if least is None else least), aggregate.over(frame))


def rolling_rv(r: Column, k: int, w: WindowSpec, least: int | None = None) -> Column:
    return F.sqrt(rolling(F.sum(r * r), r, k, w, least))


def rolling_zscore(x: Column, k: int, w: WindowSpec) -> Column:
    """By the population standard deviation; null where there is no spread or the window isn't full."""
    s = rolling(F.stddev_pop(x), x, k, w)
    return F.when(s > 1e-8, (x - rolling(F.avg(x), x, k, w)) / s)


def rolling_percentile(x: Column, k: int, w: WindowSpec) -> Column:
    """Share of the last k values that are no larger than this one; for windows of some thousand rows."""
    return F.when(F.count(x).over(last_rows(w, k)) >= k, F.size(F.filter(F.collect_list(x).over(last_rows(w, k)), lambda v: v <= x)) / k)


def cumulative_zscore(x: Column, w: WindowSpec) -> Column:
    """Against all rows so far, population variance by E[x^2] - E[x]^2 with a floor; the first row is 0."""
    c = so_far(w)
    mean = F.avg(x).over(c)
    variance = F.greatest(F.avg(x * x).over(c) - mean * mean, F.lit(1e-8))
    return F.when(F.count(x).over(c) < 2, 0.0).otherwise((x - mean) / F.sqrt(variance))


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(w))


def bfill(x: Column, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def shift_all(df: DataFrame, columns: list[str], w: WindowSpec) -> DataFrame:
    """Every column as it was a row before: what was known then."""
    return df.withColumns({c: F.lag(c, 1).over(w) for c in columns})


def percent_rank_average(x: str, keys: list[str]) -> Column:
    """Rank with ties averaged, over the number of rows."""
    w = Window.partitionBy(*keys)
    return (F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2) / F.count("*").over(w)


def zscore_of_all(x: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return (F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-8)


def with_first_last_ratio(df: DataFrame, r: str, keys: list[str], order: list[str], k: int, least: int, name: str) -> DataFrame:
    """Mean square of the first k rows over that of the last k, the same for all rows; 1 for short groups or no spread.

    As in the features it serves, early rows see the late ones.
    """
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    df = df.withColumns({"_up": F.row_number().over(series(keys, order)), "_down": F.row_number().over(down)})
    w, square = Window.partitionBy(*keys), F.col(r) * F.col(r)
    start, end = F.avg(F.when(F.col("_up") <= k, square)).over(w), F.avg(F.when(F.col("_down") <= k, square)).over(w)
    out = F.when((F.count("*").over(w) < least) | (end <= 1e-10) | end.isNull(), 1.0).otherwise(F.sqrt(start / end))
    return df.withColumn(name, out).drop("_up", "_down")


def rv_chain(df: DataFrame, r: str, w: WindowSpec, horizons: dict[str, tuple[int, int]]) -> DataFrame:
    """df with realised volatility over several horizons (rows, least rows) and what is made of it: ratios, changes over 5 and 15
    rows, acceleration, z against the last 30 rows, and that z's rank as a sigmoid; nulls of the first rows become 0.

    horizons: rv_5m, rv_15m, rv_30m, rv_1h, rv_2h.
    """
    df = df.withColumns({c: rolling_rv(F.col(r), k, w, n) for c, (k, n) in horizons.items()})
    rv = F.col("rv_30m")
    ratios = {"rv_ratio_5m_30m": ("rv_5m", "rv_30m"), "rv_ratio_15m_1h": ("rv_15m", "rv_1h"), "rv_ratio_30m_2h": ("rv_30m", "rv_2h")}
    made = {c: F.col(a) / (F.col(b) + 1e-10) for c, (a, b) in ratios.items()} | {f"rv_change_{k}": lag_diff(rv, k, w) for k in (5, 15)}
    df = df.withColumns(made | {"rv_zscore_1h": (rv - rolling(F.avg(rv), rv, 30, w)) / (rolling(F.stddev_samp(rv), rv, 30, w) + 1e-10)})
    df = df.withColumns({"rv_acceleration": lag_diff(F.col("rv_change_5"), 5, w), "rv_rank_2h": sigmoid(clip(F.col("rv_zscore_1h"), -3, 3))})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in [*horizons, *made, "rv_zscore_1h", "rv_acceleration", "rv_rank_2h"]})


def masked_zscore(x: Column, mask: Column, w: WindowSpec) -> Column:
    """z of the values that the mask lets through, by their own mean and population deviation; 0 elsewhere."""
    kept = F.when(mask, x)
    return F.when(mask, (x - F.avg(kept).over(w)) / (F.stddev_pop(kept).over(w) + 1e-8)).otherwise(0.0)


def percentile_of_long(df: DataFrame, x: str, keys: list[str], cell: str, order: list[str], k: int, name: str) -> DataFrame:
    """Share of the last k values no larger than this one, for windows too long to gather a row; null until k rows are there."""
    return percentile_rank(df, keys, cell, order, x, k, name)
