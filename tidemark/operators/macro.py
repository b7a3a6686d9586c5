"""Columns made from macro series of one row a day: spreads, flags, momentum, stress, meetings ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from . import rolling as R


def yields(short: Column, two: Column, ten: Column, thirty: Column) -> dict[str, Column]:
    """Spreads of the curve and whether it is inverted."""
    flag = lambda x: F.when(x < 0, 1.0).otherwise(0.0)
    return {
        "yield_2s10s": ten - two, "yield_3m10y": ten - short, "yield_curve_steepness": thirty - two,
        "yc_2s10s_inverted": flag(ten - two), "yc_3m10y_inverted": flag(ten - short),
    }


def credit(high_yield: Column, investment: Column, curve: Column, stress: Column, days_until: Column, w: WindowSpec) -> dict[str, Column]:
    return {
        "credit_spread": high_yield - investment, "hy_ig_ratio": high_yield / F.when(investment == 0, 1.0).otherwise(investment),
        "yield_curve_velocity": R.lag_diff(curve, 5, w, 0.0), "stress_change": R.lag_diff(stress, 1, w, 0.0), "meeting_proximity": F.exp(-days_until / 5.0),
    }


def funds_and_term(funds: Column, short: Column, near: Column, far: Column, w: WindowSpec) -> dict[str, Column]:
    """Fed funds over the three-month yield, and the near over the far volatility index, carried over days without one, 1 before the first."""
    ratio = F.when(far != 0, near / far)
    return {"ff_3m_spread": funds - short, "vix_term_ratio": F.coalesce(R.ffill(ratio, w), F.lit(1.0))}


def cross_asset(x: dict[str, Column], w: WindowSpec) -> dict[str, Column]:
    """What is made of those of the series that are there: gold, oil, hy, ig, bbb, aaa (spreads), real and infl (yields), dollar, vix, stress."""
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    z = lambda v, k: (v - R.rolling(F.avg(v), v, k, w)) / R.rolling(F.stddev_samp(v), v, k, w)
    out: dict[str, Column] = {}
    for c, spans in (("gold", (1, 5, 20)), ("oil", (1, 5, 20)), ("dollar", (5, 20))):
        if c in x:
            out |= {f"{c}_ret_{k}d": R.pct_change(x[c], k, w) for k in spans}
    if "gold" in x:
        out["gold_z_20d"] = z(x["gold"], 20)
    for c, name, spans in (("hy", "hy_oas", (5,)), ("ig", "ig_oas", (5,)), ("real", "real_yield", (5,)), ("infl", "infl_exp", (5,)), ("vix", "vix", (1, 5))):
        if c in x:
            out |= {f"{name}_chg_{k}d": R.lag_diff(x[c], k, w) for k in spans}
    if "hy" in x:
        out |= {"hy_oas_z_60d": z(x["hy"], 60), "credit_stress": flag(x["hy"] > R.rolling(F.percentile(x["hy"], 0.9), x["hy"], 252, w))}
    if "hy" in x and "ig" in x:
        out |= {"hy_ig_diff": x["hy"] - x["ig"], "hy_ig_ratio": x["hy"] / F.when(x["ig"] == 0, 1.0).otherwise(x["ig"])}
    if "bbb" in x and "aaa" in x:
        out["bbb_aaa_spread"] = x["bbb"] - x["aaa"]
    if "vix" in x:
        out |= {"vix_z_20d": z(x["vix"], 20), "vix_term_struct": R.lag_diff(x["vix"], 1, w)}
    if "stress" in x:
        out["fin_stress_elevated"] = flag(x["stress"] > 0)
    return out


def momentum(x: Column, w: WindowSpec) -> dict[str, Column]:
    """Against the mean of four rows, over four rows, and as a stressed level over the last 60."""
    mean, top = R.rolling(F.avg(x), x, 4, w), R.rolling(F.percentile(x, 0.9), x, 60, w)
    z = (x - R.rolling(F.avg(x), x, 20, w)) / R.rolling(F.stddev_samp(x), x, 20, w)
    return {"sma4": mean, "vs_sma4": x / mean - 1, "change4": R.pct_change(x, 4, w) * 100, "z20": z, "stressed": F.coalesce((x > top).cast("double"), F.lit(0.0))}


def meetings(days: DataFrame, events: DataFrame, key: str, day: str, otherwise: int = 90, near: int = 3, since_default: int | None = None, until_default: int | None = None) -> DataFrame:
    """days with days_to the next event after it, days_since the last up to it, and whether one is near either way.

    Without an event they are `otherwise`, or the defaults given for either side.
    """
    from .asof import asof

    at = events.select(key, day).distinct()
    last = asof(days, at.withColumn("_at", F.col(day)), [key], day, ["_at"]).drop(f"right_{day}").withColumnRenamed("_at", "_last")
    # The next event lies after the day itself: events count for the day before theirs.
    before = at.select(key, F.col(day).alias("_at"), F.date_sub(day, 1).alias(day))
    both = asof(last, before, [key], day, ["_at"], forward=True).drop(f"right_{day}")
    to, since = F.datediff("_at", day), F.datediff(day, "_last")
    out = both.withColumns({"days_to": F.coalesce(to, F.lit(until_default or otherwise)), "days_since": F.coalesce(since, F.lit(since_default or otherwise))})
    return out.withColumn("is_near", F.coalesce((to <= near) | (since <= near), to <= near, since <= near, F.lit(False))).drop("_last", "_at")
