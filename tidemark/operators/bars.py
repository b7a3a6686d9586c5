"""Bars: one grouped pass from ticks to open/high/low/close, volumes and shape statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, ratio
from ..sources.sinks import kept
from .ordered import matched


def bucket(ts: Column, every: str) -> Column:
    return F.window(ts, every).start


def skewness(x: str) -> Column:
    """mean((x - mean)**3) / (sample std**3 + eps), 0 for fewer than three values or no spread; in the same pass as the rest."""
    s = F.stddev_samp(x)
    return F.when((F.count(x) < 3) | (s <= 1e-10), 0.0).otherwise(F.skewness(x) * F.pow(F.stddev_pop(x), 3) / (F.pow(s, 3) + EPS))


def bars(ticks: DataFrame, every: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """ticks: keys, ts, tick_id (breaks ties), price, volume."""
    order = F.struct("ts", "tick_id")
    volume = F.sum("volume")
    aggregates = [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        volume.alias("volume"), F.count("*").alias("trade_count"), F.avg("price").alias("price_mean"), F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("price_std"),
        ratio(F.sum(F.col("price") * F.col("volume")), volume).alias("vwap_sum"), F.max_by("price", order).alias("last_price"), skewness("price").alias("price_skew"),
    ]
    out = ticks.groupBy(*keys, bucket(F.col("ts"), every).alias("bar")).agg(*aggregates)
    return out.withColumn("vwap", F.when(F.col("volume") > 0, F.col("vwap_sum")).otherwise(F.col("last_price"))).drop("vwap_sum", "last_price")


def derived(b: DataFrame) -> DataFrame:
    c = F.col
    return b.withColumns({
        "price_range": c("high") - c("low"), "price_range_pct": ratio(c("high") - c("low"), c("open")) * 100, "avg_trade_size": ratio(c("volume"), c("trade_count")),
        "close_vs_vwap": c("close") - c("vwap"), "high_vs_vwap": c("high") - c("vwap"), "low_vs_vwap": c("low") - c("vwap"), "close_return": ratio(c("close") - c("open"), c("open")),
        "volume_per_trade": c("volume") / (c("trade_count") + 1), "high_low_ratio": (c("high") - c("low")) / (c("low") + EPS), "close_position": (c("close") - c("low")) / (c("high") - c("low") + EPS),
    })


MEAN_NAMES = ("ratio", "skew", "vs_20d")


def roll_up(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Across entities: mean of the columns whose name says ratio, skew or vs_20d, sum of the others."""
    return rows.groupBy(*keys).agg(*[(F.avg if any(m in v for m in MEAN_NAMES) else F.sum)(v).alias(v) for v in values])


def micro_roll_up(fine: DataFrame, keys: list, seconds: int) -> DataFrame:
    """Fine bars with trade measures to coarse ones: spread by trades, shares by volume, sums of what adds up. seconds: a coarse bar's length."""
    c, total = F.col, F.sum
    weighted = lambda x, by: ratio(total(c(x) * c(by)), total(by))
    return fine.groupBy(*keys).agg(
        ratio(total("volume"), total("trade_count")).alias("avg_trade_size"), weighted("std_trade_size", "trade_count").alias("std_trade_size"), F.max("max_trade_size").alias("max_trade_size"),
        F.avg("amihud").alias("amihud"), weighted("large_trade_ratio", "volume").alias("large_trade_ratio"), (total("trade_count") / float(seconds)).alias("tick_arrival_rate"),
        *[total(x).alias(x) for x in ("buy_volume", "sell_volume", "rv_intrabar", "bpv_intrabar", "ofi")],
    )


#: Names of option measures by how they add up: fixed values of the output contract.
OPTION_SUMS = (
    "call_volume put_volume call_trade_count put_trade_count total_volume total_trade_count call_premium_total put_premium_total large_premium_total near_volume mid_volume far_volume "
    "otm_put_volume atm_volume otm_call_volume deep_otm_put_volume total_large_trade_count call_large_count put_large_count net_large_flow uoa_call_count uoa_put_count"
).split()
OPTION_MEANS = "near_pc_ratio far_pc_ratio term_skew avg_volume_surprise".split()
OPTION_MAXES = "sweep_intensity max_volume_surprise".split()
OPTION_LASTS = "unique_contracts unique_strikes unique_expiries pc_ratio_vs_20d call_volume_vs_20d put_volume_vs_20d".split()
OPTION_RATIOS = {
    "put_call_ratio_volume": ("put_volume", "call_volume"), "put_call_ratio_count": ("put_trade_count", "call_trade_count"), "skew_proxy": ("otm_put_volume", "atm_volume"), "atm_concentration": ("atm_volume", "total_volume"),
}


def options_roll_up(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """All option measures of a bar and the nine made from them; ratios come from the bar's own sums.

    The last values come from a second reading: only the rows at the largest order[0] of their bar are compared by all of `order`, for
    an aggregate that holds structs is sorted, and would sort every row with all its measures.
    """
    names = rows.select(*keys).columns
    facts = kept(rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in OPTION_SUMS], *[F.avg(c).alias(c) for c in OPTION_MEANS], *[F.max(c).alias(c) for c in OPTION_MAXES],
        *[(F.sum(a) / (F.sum(b) + EPS)).alias(c) for c, (a, b) in OPTION_RATIOS.items()], F.max(order[0]).alias("_last"),
    ))
    own = rows.select(*keys, *[F.col(c).alias(f"_of_{c}") for c in dict.fromkeys([*order, *OPTION_LASTS])])
    late = matched(own, facts.select(*names, F.col("_last").alias(f"_of_{order[0]}")), [*names, f"_of_{order[0]}"])
    last = F.struct(*[f"_of_{c}" for c in order])
    ends = late.groupBy(*names).agg(*[F.max_by(f"_of_{c}", last).alias(c) for c in OPTION_LASTS])
    out = matched(facts, ends, names).select(*names, *OPTION_SUMS, *OPTION_MEANS, *OPTION_MAXES, *OPTION_LASTS, *OPTION_RATIOS)
    c = F.col
    over = lambda a, b: a / (b + EPS)
    flow, unusual = c("call_premium_total") - c("put_premium_total"), c("uoa_call_count") + c("uoa_put_count")
    return out.withColumns({
        "net_premium_flow": flow, "premium_imbalance": over(flow, c("call_premium_total") + c("put_premium_total")), "large_trade_pct": over(c("total_large_trade_count"), c("total_trade_count")),
        "put_large_pct": over(c("put_large_count"), c("total_large_trade_count")), "uoa_total": unusual, "uoa_put_bias": over(c("uoa_put_count"), unusual), "deep_otm_put_pct": over(c("deep_otm_put_volume"), c("total_volume")),
        "near_far_ratio": over(c("near_volume"), c("far_volume")), "sweep_to_trade_ratio": over(c("sweep_intensity"), c("total_trade_count")),
    })
