"""Company statements by sector: what is known at a date, margins and ratios of sums, growth, standardised figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded(a: Column, b: Column) -> Column:
    """Ratio of two sums, 0 unless the second is over 0."""
    return F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)


def by_company(filings: DataFrame, key: str, each: int = 65_536) -> DataFrame:
    """filings dealt by key to a partition for every `each` rows: what is grouped by the key and more stays there, and no task's groups grow with the table."""
    return filings.repartition(max(1, -(-filings.count() // each)), key)


def latest_values(dates: DataFrame, filings: DataFrame, key: str, day: str, filed: str, values: list[str], valid_days: int = 180) -> DataFrame:
    """For each date and key the last value of each column that was filed by then and is no older than valid_days.

    Columns are looked at one by one: a filing without a value leaves the one before it. Filings meet dates by month;
    the dates, at most a row a calendar day, go to every task. Of filings that lie `by_company` nothing else moves.
    """
    month = F.sequence(F.trunc(filed, "MM"), F.trunc(F.date_add(filed, valid_days), "MM"), F.expr("interval 1 month"))
    held = filings.withColumn("_month", F.explode(month))
    rows = held.join(F.broadcast(dates.withColumn("_month", F.trunc(day, "MM"))), "_month")
    rows = rows.where((F.col(filed) <= F.col(day)) & (F.col(filed) >= F.date_sub(day, valid_days)))
    return rows.groupBy(day, key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(filed))).alias(v) for v in values])


def income(latest: DataFrame, keys: list[str], key: str) -> DataFrame:
    """latest: keys, key, revenue, gross_profit, operating_income, net_income. Growth runs over a group's companies by key."""
    revenue, net = F.col("revenue"), F.col("net_income")
    before = F.last("revenue", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    rows = latest.withColumn("_growth", F.when(revenue.isNotNull(), F.try_divide(revenue - before, before)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_reported"), F.coalesce(F.avg("_growth"), F.lit(0.0)).alias("rev_growth"), guarded(F.col("gross_profit"), revenue).alias("gross_margin"),
        guarded(F.col("operating_income"), revenue).alias("op_margin"), guarded(net, revenue).alias("net_margin"),
        F.coalesce(F.avg(F.when(net.isNotNull(), (net > 0).cast("double"))), F.lit(0.0)).alias("pct_profitable"),
    )


def balance(latest: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return latest.groupBy(*keys).agg(
        guarded(c("liabilities"), c("equity")).alias("debt_equity"), guarded(c("current_assets"), c("current_liabilities")).alias("current_ratio"),
        guarded(c("cash"), c("current_liabilities")).alias("cash_ratio"),
    )


def cash_flow(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Free cash flow over assets, and buybacks in billions."""
    free = F.coalesce(F.sum("operating_cash"), F.lit(0.0)) - F.coalesce(F.sum(F.abs("capex")), F.lit(0.0))
    margin = F.when(F.sum("assets") > 0, free / F.sum("assets")).otherwise(0.0)
    return latest.groupBy(*keys).agg(margin.alias("fcf_margin"), (F.coalesce(F.sum(F.abs("buybacks")), F.lit(0.0)) / 1e9).alias("buyback_rate"))


def standardised(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """df with z of each column. With train the statistics come from those rows alone, by population deviation plus 1e-8; without, by sample deviation, 0 without spread."""
    of = df if train is None else df.where(train)
    spread = F.stddev_samp if train is None else F.stddev_pop
    facts = of.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", spread))])  # one row

    def z(c: str) -> Column:
        away, s = F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")
        return F.when(s > 0, away / s).otherwise(0.0) if train is None else away / (s + 1e-8)

    return df.join(F.broadcast(facts)).withColumns({f"{c}_z": z(c) for c in columns}).drop(*facts.columns)


def expanding(dates: DataFrame, filings: DataFrame, keys: list[str], day: str, filed: str, year: str, value: str) -> DataFrame:
    """For each row of dates (keys, day, year), of the key's filings made by that day for its fiscal year or the one before: their number and sum.

    Filings add up within key and fiscal year in the order of days; a date asks two years for their last sum, as of itself.
    """
    from .asof import asof

    per_day = filings.groupBy(*keys, year, F.col(filed).alias(day)).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    w = Window.partitionBy(*keys, year).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    sums = per_day.select(*keys, year, day, F.sum("_n").over(w).alias("n"), F.sum("_v").over(w).alias("total"))
    asked = dates.select(*keys, day, F.explode(F.array(F.col(year), F.col(year) - 1)).alias(year))
    found = asof(asked, sums, [*keys, year], day, ["n", "total"])
    return found.groupBy(*keys, day).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
