"""More queries of the reference-side operators: statements, volatility chains, option and bar measures, macro columns,
samples, cleaning, sets, losses, files. Roles of the tables as in the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import bars as B
from ..operators import cleaning as K
from ..operators import long_series as L
from ..operators import macro as M
from ..operators import ordered as O
from ..operators import quantiles
from ..operators import rolling as R
from ..operators import samples as P
from ..operators import sequences as Q
from ..operators import statements as N
from ..sources import files, sinks
from ..streaming import bars as streams
from ..streaming import state as running
from ..streaming.sinks import drained, shared_folder
from .catalogue import BARS, DAILY, DAYS, PRED, RETURNS, TICKS, _days, _full, _predictions, _tick_stream, daily, query_of, rounded, t, ticks

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_of(QUERIES, SQL)


# --- company statements by sector -------------------------------------------------------------------------------------

#: Columns of a statement, as SQL over one order; what an order lacks is null.
STATEMENT = {
    "revenue": "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END", "gross_profit": "o_totalprice * 0.4", "operating_income": "o_totalprice * ((o_orderkey % 7) - 2) / 20",
    "net_income": "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * ((o_orderkey % 5) - 1) / 25 END", "liabilities": "o_totalprice * (1 + o_orderkey % 3)", "equity": "o_totalprice * ((o_orderkey % 6) - 1)",
    "current_assets": "o_totalprice / 2", "current_liabilities": "o_totalprice * (o_orderkey % 4) / 5", "cash": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 10 END",
    "operating_cash": "o_totalprice * 0.2", "capex": "-o_totalprice * (o_orderkey % 4) / 30", "assets": "o_totalprice * 3", "buybacks": "-o_totalprice * (o_orderkey % 2)",
}
ST = (
    "st AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filed, " + ", ".join(f"sum({v}) AS {k}" for k, v in STATEMENT.items()) + " FROM orders GROUP BY 1, 2), "
    "dates AS (SELECT DISTINCT CAST(date_trunc('month', filed) AS DATE) AS day FROM st), lv AS (SELECT d.day, s.ticker, "
    + ", ".join(f"arg_max({k}, filed) FILTER (WHERE {k} IS NOT NULL) AS {k}" for k in STATEMENT)
    + " FROM dates d JOIN st s ON s.filed <= d.day AND s.filed >= d.day - 180 GROUP BY 1, 2), "
    "latest AS (SELECT lv.*, left(replace(lower(c_mktsegment), ' ', '_'), 8) AS sector FROM lv JOIN customer ON c_custkey = ticker)"
)


def _latest(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    st = N.by_company(o, "o_custkey").groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("filed")).agg(*[F.sum(F.expr(v)).alias(k) for k, v in STATEMENT.items()])
    dates = o.select(F.trunc(F.to_date("o_orderdate"), "MM").alias("day")).where("day is not null").distinct()
    held = N.latest_values(dates, st, "ticker", "day", "filed", list(STATEMENT))
    return held.join(t(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), S.short_name(F.col("c_mktsegment")).alias("sector")), "ticker")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN sum({b}) > 0 THEN sum({a}) / sum({b}) ELSE 0 END"


@query(f"""WITH {ST}, g AS (SELECT *, last_value(revenue IGNORE NULLS) OVER (PARTITION BY day, sector ORDER BY ticker ROWS
  BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM latest)
  SELECT CAST(day AS VARCHAR) AS day, sector, count(*) AS n_reported, round(coalesce(avg((revenue - before) / nullif(before,
  0)), 0), 4) AS rev_growth, round({_ratio('gross_profit', 'revenue')}, 4) AS gross_margin,
  round({_ratio('operating_income', 'revenue')}, 4) AS op_margin, round({_ratio('net_income', 'revenue')}, 4) AS
  net_margin, round(coalesce(avg(CASE WHEN net_income > 0 THEN 1.0 WHEN net_income IS NOT NULL THEN 0 END), 0),
  4) AS pct_profitable FROM g GROUP BY 1, 2""")
def sector_income(spark, d):
    return rounded(N.income(_latest(spark, d), ["day", "sector"], "ticker"))


@query(f"""WITH {ST} SELECT CAST(day AS VARCHAR) AS day, sector, round({_ratio('liabilities', 'equity')}, 4) AS debt_equity,
  round({_ratio('current_assets', 'current_liabilities')}, 4) AS current_ratio, round({_ratio('cash', 'current_liabilities')},
  4) AS cash_ratio FROM latest GROUP BY 1, 2""")
def sector_balance(spark, d):
    return rounded(N.balance(_latest(spark, d), ["day", "sector"]))


@query(f"""WITH {ST} SELECT CAST(day AS VARCHAR) AS day, sector, round(CASE WHEN sum(assets) > 0 THEN (coalesce(sum(operating_cash),
  0) - coalesce(sum(abs(capex)), 0)) / sum(assets) ELSE 0 END, 6) AS fcf_margin, round(coalesce(sum(abs(buybacks)),
  0) / 1e9, 8) AS buyback_rate FROM latest GROUP BY 1, 2""")
def sector_cash_flow(spark, d):
    x = N.cash_flow(_latest(spark, d), ["day", "sector"])
    return x.select(F.col("day").cast("string").alias("day"), "sector", F.round("fcf_margin", 6).alias("fcf_margin"), F.round("buyback_rate", 8).alias("buyback_rate"))


SECTORS = "AUTOMOBI BUILDING FURNITUR HOUSEHOL MACHINER".lower().split()


@query(f"WITH {ST}, x AS (SELECT day, sector, {_ratio('net_income', 'revenue')} AS m FROM latest GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(f"round(any_value(m) FILTER (WHERE sector = '{s}'), 4) AS {s}" for s in SECTORS) + " FROM x GROUP BY 1")
def sector_wide(spark, d):
    x = N.income(_latest(spark, d), ["day", "sector"], "ticker").select("day", "sector", "net_margin")
    return rounded(x.groupBy("day").pivot("sector", SECTORS).agg(F.first("net_margin")))


SIDES = "a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, sum(o_totalprice) AS revenue, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2, 3), b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, max(o_totalprice) AS most, 7 AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2, 3)"


@query(f"""WITH {SIDES} SELECT k, CAST(day AS VARCHAR) AS day, p, round(revenue, 2) AS revenue, n, round(most, 2) AS most
  FROM (SELECT coalesce(a.k, b.k) AS k, coalesce(a.day, b.day) AS day, coalesce(a.p, b.p) AS p, revenue, a.n, most
  FROM a FULL JOIN b ON a.k = b.k AND a.day = b.day AND a.p = b.p)""")
def statements_outer_join(spark, d):
    o, keys = t(spark, d, "orders"), [F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p")]
    a = o.where("o_orderkey % 3 != 1").groupBy(*keys).agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    b = o.where("o_orderkey % 3 != 0").groupBy(*keys).agg(F.max("o_totalprice").alias("most"), F.lit(7).alias("n"))
    return rounded(K.outer_all([a, b], ["k", "day", "p"]), 2)


@query("""WITH m AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice
  - m) / s, 4) AS z FROM orders, m WHERE abs((o_totalprice - m) / s) > 1.5""")
def large_moves(spark, d):
    x = N.standardised(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumnRenamed("o_totalprice_z", "z")
    return rounded(K.large_moves(x, "z", 1.5).select("o_orderkey", "z"))


@query("""WITH m AS (SELECT avg(l_quantity) AS q, stddev_pop(l_quantity) + 1e-8 AS qs, avg(l_tax) AS x, stddev_pop(l_tax)
  + 1e-8 AS xs FROM lineitem WHERE l_shipdate <= DATE '1998-12-31') SELECT l_orderkey, l_linenumber, l_partkey,
  round((l_quantity - q) / qs, 4) AS quantity_z, round((l_tax - x) / xs, 4) AS tax_z FROM lineitem, m""")
def train_only_zscore(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    z = N.standardised(x, ["quantity", "tax"], F.col("l_shipdate") <= F.lit("1998-12-31").cast("date"))
    return rounded(z.select("l_orderkey", "l_linenumber", "l_partkey", "quantity_z", "tax_z"))


FY = "CAST(year({0}) - CASE WHEN month({0}) <= 3 THEN 1 ELSE 0 END AS INTEGER)"


@query(f"""WITH f AS (SELECT c_mktsegment AS sector, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS v, CAST(year(o_orderdate)
  AS INTEGER) AS fy FROM orders JOIN customer ON c_custkey = o_custkey), q AS (SELECT DISTINCT sector, CAST(date_trunc('month',
  filed) AS DATE) AS day FROM f), d AS (SELECT *, {FY.format('day')} AS fy FROM q)
  SELECT d.sector, CAST(d.day AS VARCHAR) AS day, count(f.v) AS n, round(coalesce(sum(f.v), 0), 2) AS total FROM
  d LEFT JOIN f ON f.sector = d.sector AND f.filed <= d.day AND f.fy IN (d.fy, d.fy - 1) GROUP BY 1, 2""")
def expanding_history(spark, d):
    f = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = f.select(F.col("c_mktsegment").alias("sector"), F.to_date("o_orderdate").alias("filed"), F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("fy"))
    dates = f.select("sector", F.trunc("filed", "MM").alias("day")).distinct().withColumn("fy", S.fiscal_year(F.col("day")))
    return rounded(N.expanding(dates, f, ["sector"], "day", "filed", "fy", "v"), 2)


@query(f"""SELECT o_orderkey, {FY.format('o_orderdate')} AS fy, CASE WHEN month(o_orderdate) <= 3 THEN 'Q4' WHEN month(o_orderdate)
  <= 6 THEN 'Q1' WHEN month(o_orderdate) <= 9 THEN 'Q2' ELSE 'Q3' END AS fp, CAST(CAST(CAST(o_orderdate AS DATE)
  AS TIMESTAMP) + INTERVAL 16 HOUR AS VARCHAR) AS filed_at FROM orders""")
def fiscal_period(spark, d):
    day = F.to_date("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", S.fiscal_year(day).alias("fy"), S.fiscal_quarter(day).alias("fp"), S.filed_at(day).cast("string").alias("filed_at"))


#: Ranges of industry codes, the first that fits counts: fixed values.
SIC = [
    (100, 1000, "Energy"), (1000, 1500, "Materials"), (1500, 1800, "Materials"), (2000, 4000, "Industrials"), (4000, 5000, "Utilities"), (5000, 5200, "Consumer Discretionary"), (5200, 6000, "Consumer Staples"),
    (6000, 6800, "Financials"), (7000, 7400, "Communication Services"), (7370, 7380, "Information Technology"), (7300, 7400, "Information Technology"), (8000, 8100, "Health Care"),
    (8700, 8800, "Information Technology"), (9000, 10000, "Real Estate"),
]


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, CASE " + " ".join(f"WHEN p_partkey * 37 % 10007 >= {a} AND p_partkey * 37 % 10007 < {b} THEN '{s}'" for a, b, s in SIC) + " ELSE 'Unknown' END AS sector FROM part")
def sector_of_code(spark, d):
    code = F.col("p_partkey") * 37 % 10007
    return t(spark, d, "part").select("p_partkey", S.zero_pad(F.col("p_partkey")).alias("cik"), S.first_range(code, SIC, "Unknown").alias("sector"))


@query("""SELECT o_orderkey, round(CASE WHEN c_acctbal = 0 THEN 0 ELSE (o_totalprice - c_acctbal) / abs(c_acctbal) * 100
  END, 4) AS surprise, CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END
  AS impact, CAST(['A', 'B' || o_custkey] AS VARCHAR) AS tickers, 'A' AS first_ticker FROM orders JOIN customer
  ON c_custkey = o_custkey""")
def surprise_and_impact(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "123", "HML")
    listed = S.parse_list(F.concat(F.lit("['A', 'B"), F.col("o_custkey"), F.lit("']")))
    return rounded(o.select("o_orderkey", S.surprise(F.col("o_totalprice"), F.col("c_acctbal")).alias("surprise"), S.ordinal(letter).alias("impact"), F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("tickers"), F.element_at(listed, 1).alias("first_ticker")))


# --- volatility chain -------------------------------------------------------------------------------------------------

HORIZONS = {"rv_5m": (3, 1), "rv_15m": (8, 4), "rv_30m": (15, 7), "rv_1h": (30, 15), "rv_2h": (60, 30)}
RV_COLUMNS = ["rv_ratio_5m_30m", "rv_ratio_15m_1h", "rv_ratio_30m_2h", "rv_change_5", "rv_change_15", "rv_acceleration", "rv_zscore_1h", "rv_rank_2h"]
W_DAY = f"OVER ({DAYS})"
CHAIN = (
    f"{RETURNS}, h AS (SELECT flag, day, " + ", ".join(f"sqrt({_full('sum(ret * ret) $', 'ret', k, DAYS, n)}) AS {c}" for c, (k, n) in HORIZONS.items()) + " FROM r), "
    f"c AS (SELECT *, rv_5m / (rv_30m + 1e-10) AS rv_ratio_5m_30m, rv_15m / (rv_1h + 1e-10) AS rv_ratio_15m_1h, rv_30m / (rv_2h + 1e-10) AS rv_ratio_30m_2h, rv_30m - lag(rv_30m, 5) {W_DAY} AS rv_change_5, rv_30m - lag(rv_30m, 15) {W_DAY} AS rv_change_15, "
    f"(rv_30m - {_full('avg(rv_30m) $', 'rv_30m', 30, DAYS)}) / ({_full('stddev_samp(rv_30m) $', 'rv_30m', 30, DAYS)} + 1e-10) AS rv_zscore_1h FROM h), "
    f"e AS (SELECT *, rv_change_5 - lag(rv_change_5, 5) {W_DAY} AS rv_acceleration, 1 / (1 + exp(-least(greatest(rv_zscore_1h, -3), 3))) AS rv_rank_2h FROM c)"
)


@query(f"WITH {CHAIN} SELECT flag, CAST(day AS VARCHAR) AS day, " + ", ".join(f"round(coalesce(CASE WHEN {'rv_zscore_1h' if c == 'rv_rank_2h' else c} IS NOT NULL THEN {c} END, 0), 4) + 0 AS {c}" for c in RV_COLUMNS) + " FROM e")
def rv_chain(spark, d):
    x, w = _days(spark, d)
    return rounded(R.rv_chain(x.withColumn("ret", R.log_return(F.col("v"), w)), "ret", w, HORIZONS).select("flag", "day", *RV_COLUMNS))


@query(f"""WITH {BARS}, spy AS (SELECT CAST(bar AS DATE) AS day, arg_max(close, bar) AS close FROM agg WHERE ticker = 'view'
  GROUP BY 1), r AS (SELECT day, ln(close / lag(close) OVER (ORDER BY day)) AS ret FROM spy), v AS (SELECT day,
  CASE WHEN count(ret) OVER w >= 5 THEN sqrt(sum(ret * ret) OVER w) END * sqrt(252 * 4) * 100 AS rv FROM r WINDOW
  w AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT CAST(a.bar AS VARCHAR) AS bar, round(a.close, 4) AS vix, round(b.close, 4) AS vvix, round(v.rv / (a.close
  + 1e-8), 3) AS rv_ratio FROM agg a LEFT JOIN agg b ON b.bar = a.bar AND b.ticker = 'error' LEFT JOIN v ON v.day
  = CAST(a.bar AS DATE) WHERE a.ticker = 'click'""")
def vix_features(spark, d):
    b = B.bars(ticks(spark, d), "6 hours").select("ticker", "bar", "close")
    side = lambda k, name: b.where(F.col("ticker") == k).select("bar", F.col("close").alias(name))
    spy = side("view", "close").groupBy(F.to_date("bar").alias("day")).agg(F.max_by("close", "bar").alias("close"))
    w = Window.orderBy("day")  # a row a calendar day
    spy = spy.withColumn("r", R.log_return(F.col("close"), w)).select("day", S.annualised(R.rolling_rv(F.col("r"), 5, w), 4).alias("rv"))
    x = side("click", "vix").join(side("error", "vvix"), "bar", "left").withColumn("day", F.to_date("bar")).join(spy, "day", "left")
    return x.select(F.col("bar").cast("timestamp_ntz").cast("string").alias("bar"), F.round("vix", 4).alias("vix"), F.round("vvix", 4).alias("vvix"), F.round(F.col("rv") / (F.col("vix") + 1e-8), 3).alias("rv_ratio"))


@query(f"""WITH {TICKS}, s AS (SELECT ticker, (n - 1) // 40 AS segment, min(ts) AS a, max(ts) AS b FROM (SELECT ticker, ts,
  row_number() OVER (PARTITION BY ticker ORDER BY ts, tick_id) AS n FROM ticks) GROUP BY 1, 2)
  SELECT s.ticker, CAST(segment AS BIGINT) AS segment, count(*) AS tokens FROM s JOIN ticks x ON x.ticker = CASE
  s.ticker WHEN 'view' THEN 'click' WHEN 'click' THEN 'view' ELSE s.ticker END AND x.ts <= b AND (x.ts >= a OR
  segment = 0) GROUP BY 1, 2""")
def open_first_segment(spark, d):
    x = ticks(spark, d).withColumn("day", F.to_date("ts"))
    s = O.cut(x, ["ticker"], "day", ["ts", "tick_id"], 40, "segment").groupBy("ticker", "segment").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    other = F.when(F.col("ticker") == "view", "click").when(F.col("ticker") == "click", "view").otherwise(F.col("ticker"))
    found = A.last_end(ticks(spark, d).select(other.alias("ticker"), "ts"), s, ["ticker"], "ts", "segment", lambda c: F.to_date(c))
    return found.groupBy("ticker", "segment").agg(F.count("*").alias("tokens"))


# --- bars and options: all measures -----------------------------------------------------------------------------------

HOURLY = f"""{TICKS}, m AS (SELECT ticker, time_bucket(INTERVAL '1 hour', ts) AS hour, sum(volume) AS volume, count(*) AS trade_count, coalesce(stddev_samp(volume), 0) AS std_trade_size, max(volume) AS max_trade_size, avg(price) AS amihud, sum(CASE WHEN tick_id % 2 = 0 THEN volume ELSE 0 END) AS buy_volume,
  sum(CASE WHEN tick_id % 2 = 1 THEN volume ELSE 0 END) AS sell_volume, avg(CASE WHEN volume > 50 THEN 1.0 ELSE 0 END) AS large_trade_ratio, sum(price * price) AS rv_intrabar, sum(abs(price)) AS bpv_intrabar FROM ticks GROUP BY 1, 2)"""


@query(f"""WITH {HOURLY} SELECT ticker, CAST(time_bucket(INTERVAL '6 hours', hour) AS VARCHAR) AS bar, round(CASE WHEN sum(trade_count)
  > 0 THEN sum(volume) / sum(trade_count) ELSE 0 END, 7) AS avg_trade_size, round(CASE WHEN sum(trade_count) >
  0 THEN sum(std_trade_size * trade_count) / sum(trade_count) ELSE 0 END, 7) AS std_trade_size, max(max_trade_size)
  AS max_trade_size,
  round(avg(amihud), 7) AS amihud, round(sum(buy_volume), 4) AS buy_volume, round(sum(sell_volume), 4) AS sell_volume,
  round(sum(trade_count) / 21600.0, 8) AS tick_arrival_rate, round(CASE WHEN sum(volume) > 0 THEN sum(large_trade_ratio
  * volume) / sum(volume) ELSE 0 END, 7) AS large_trade_ratio,
  round(sum(rv_intrabar), 5) AS rv_intrabar, round(sum(bpv_intrabar), 5) AS bpv_intrabar, round(sum(buy_volume -
  sell_volume), 4) AS ofi FROM m GROUP BY 1, 2""")
def bars_microstructure(spark, d):
    v = F.col("volume")
    side = lambda k: F.sum(F.when(F.col("tick_id") % 2 == k, v).otherwise(0.0))
    m = ticks(spark, d).groupBy("ticker", B.bucket(F.col("ts"), "1 hour").alias("hour")).agg(
        F.sum(v).alias("volume"), F.count("*").alias("trade_count"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_trade_size"), F.max(v).alias("max_trade_size"), F.avg("price").alias("amihud"),
        side(0).alias("buy_volume"), side(1).alias("sell_volume"), F.avg((v > 50).cast("double")).alias("large_trade_ratio"), F.sum(F.col("price") * F.col("price")).alias("rv_intrabar"), F.sum(F.abs("price")).alias("bpv_intrabar"),
    )
    x = B.micro_roll_up(m.withColumns({"ofi": F.col("buy_volume") - F.col("sell_volume")}), ["ticker", B.bucket(F.col("hour"), "6 hours").alias("bar")], 21600)
    places = {"tick_arrival_rate": 8, "rv_intrabar": 5, "bpv_intrabar": 5, "buy_volume": 4, "sell_volume": 4, "ofi": 4}
    return x.select("ticker", F.col("bar").cast("timestamp_ntz").cast("string").alias("bar"), *[F.round(c, places.get(c, 7)).alias(c) for c in x.columns if c not in ("ticker", "bar")])


#: Raw option columns, as SQL over one line item; measures are B.OPTION_SUMS and so on.
OPTION_RAW = {
    "call_volume": "CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END", "put_volume": "CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END", "call_trade_count": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "put_trade_count": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END", "total_volume": "l_quantity", "total_trade_count": "1", "call_premium_total": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END",
    "put_premium_total": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END", "large_premium_total": "CASE WHEN l_quantity > 40 THEN l_extendedprice ELSE 0 END", "near_volume": "CASE WHEN l_linenumber <= 2 THEN l_quantity ELSE 0 END",
    "mid_volume": "CASE WHEN l_linenumber BETWEEN 3 AND 4 THEN l_quantity ELSE 0 END", "far_volume": "CASE WHEN l_linenumber > 4 THEN l_quantity ELSE 0 END", "near_pc_ratio": "l_discount", "far_pc_ratio": "l_tax", "term_skew": "l_discount - l_tax",
    "otm_put_volume": "CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END", "atm_volume": "CASE WHEN l_discount BETWEEN 0.02 AND 0.05 THEN l_quantity ELSE 0 END", "otm_call_volume": "CASE WHEN l_discount < 0.02 THEN l_quantity ELSE 0 END",
    "deep_otm_put_volume": "CASE WHEN l_discount > 0.08 THEN l_quantity ELSE 0 END", "total_large_trade_count": "CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END", "call_large_count": "CASE WHEN l_quantity > 40 AND l_linestatus = 'O' THEN 1 ELSE 0 END",
    "put_large_count": "CASE WHEN l_quantity > 40 AND l_linestatus = 'F' THEN 1 ELSE 0 END", "net_large_flow": "CASE WHEN l_quantity > 40 THEN l_tax - 0.04 ELSE 0 END", "sweep_intensity": "l_tax", "max_volume_surprise": "l_quantity / 25",
    "avg_volume_surprise": "l_quantity / 25", "uoa_call_count": "CASE WHEN l_tax > 0.06 AND l_linestatus = 'O' THEN 1 ELSE 0 END", "uoa_put_count": "CASE WHEN l_tax > 0.06 AND l_linestatus = 'F' THEN 1 ELSE 0 END",
    "unique_contracts": "l_partkey", "unique_strikes": "l_suppkey", "unique_expiries": "l_linenumber", "pc_ratio_vs_20d": "l_discount", "call_volume_vs_20d": "l_quantity", "put_volume_vs_20d": "l_tax",
}
OPTION_SQL = (
    [f"sum({c}) AS {c}" for c in B.OPTION_SUMS] + [f"avg({c}) AS {c}" for c in B.OPTION_MEANS] + [f"max({c}) AS {c}" for c in B.OPTION_MAXES]
    + [f"arg_max({c}, (ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS {c}" for c in B.OPTION_LASTS] + [f"sum({a}) / (sum({b}) + 1e-8) AS {c}" for c, (a, b) in B.OPTION_RATIOS.items()]
)
DERIVED = {
    "net_premium_flow": "call_premium_total - put_premium_total", "premium_imbalance": "(call_premium_total - put_premium_total) / (call_premium_total + put_premium_total + 1e-8)", "large_trade_pct": "total_large_trade_count / (total_trade_count + 1e-8)",
    "put_large_pct": "put_large_count / (total_large_trade_count + 1e-8)", "uoa_total": "uoa_call_count + uoa_put_count", "uoa_put_bias": "uoa_put_count / (uoa_call_count + uoa_put_count + 1e-8)", "deep_otm_put_pct": "deep_otm_put_volume / (total_volume + 1e-8)",
    "near_far_ratio": "near_volume / (far_volume + 1e-8)", "sweep_to_trade_ratio": "sweep_intensity / (total_trade_count + 1e-8)",
}


@query("WITH x AS (SELECT l_returnflag AS underlying, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in OPTION_RAW.items()) + f" FROM lineitem), a AS (SELECT underlying, date_trunc('month', ts) AS bar, {', '.join(OPTION_SQL)} FROM x GROUP BY 1, 2), b AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in DERIVED.items()) + " FROM a) SELECT underlying, CAST(bar AS VARCHAR) AS bar, " + ", ".join(f"round({c}, CASE WHEN abs({c}) > 1000 THEN 2 ELSE 9 END) + 0 AS {c}" for c in [*B.OPTION_SUMS, *B.OPTION_MEANS, *B.OPTION_MAXES, *B.OPTION_LASTS, *B.OPTION_RATIOS, *DERIVED]) + " FROM b")
def options_all(spark, d):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("underlying"), F.col("l_shipdate").alias("ts"), *ids, *[F.expr(v).cast("double").alias(k) for k, v in OPTION_RAW.items()])
    a = B.options_roll_up(x, ["underlying", F.date_trunc("month", "ts").alias("bar")], ["ts", *ids])
    shown = lambda c: (F.when(F.abs(F.col(c)) > 1000, F.round(c, 2)).otherwise(F.round(c, 9)) + 0.0).alias(c)
    return a.select("underlying", F.col("bar").cast("timestamp_ntz").cast("string").alias("bar"), *[shown(c) for c in a.columns if c not in ("underlying", "bar")])


# --- macro ------------------------------------------------------------------------------------------------------------

#: Daily series: the mean discount (times 100) and tax of each line number, what a day lacks carried on.
MACRO = {"dgs3mo": ("l_discount", 1), "dgs2": ("l_discount", 2), "dgs10": ("l_discount", 3), "dgs30": ("l_discount", 4), "hy": ("l_tax", 5), "ig": ("l_tax", 6), "stress": ("l_tax", 7)}
MACRO_SQL = (
    "x AS (SELECT CAST(l_shipdate AS DATE) AS day, " + ", ".join(f"avg(CASE WHEN l_linenumber = {n} THEN {v} * 100 END) AS {c}" for c, (v, n) in MACRO.items()) + " FROM lineitem GROUP BY 1), "
    "k AS (SELECT * FROM x WHERE " + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in MACRO) + " >= 3), "
    "m AS (SELECT day, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS {c}" for c in MACRO) + " FROM k)"
)


def _macro(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(*[F.avg(F.when(F.col("l_linenumber") == n, F.col(v) * 100)).alias(c) for c, (v, n) in MACRO.items()])
    w = Window.orderBy("day")  # a row a calendar day
    return K.with_values(x, list(MACRO), 0.5).select("day", *[R.ffill(F.col(c), w).alias(c) for c in MACRO]), w


@query(f"""WITH {MACRO_SQL} SELECT CAST(day AS VARCHAR) AS day, round(dgs10 - dgs2, 4) + 0 AS yield_2s10s, round(dgs10 - dgs3mo,
  4) + 0 AS yield_3m10y, round(dgs30 - dgs2, 4) + 0 AS yield_curve_steepness, CASE WHEN dgs10 - dgs2 < 0 THEN 1e0
  ELSE 0 END AS yc_2s10s_inverted, CASE WHEN dgs10 - dgs3mo < 0 THEN 1e0 ELSE 0 END AS yc_3m10y_inverted FROM m""")
def macro_yields(spark, d):
    m, _ = _macro(spark, d)
    return rounded(m.select("day", *[v.alias(k) for k, v in M.yields(*[F.col(c) for c in ("dgs3mo", "dgs2", "dgs10", "dgs30")]).items()]))


@query(f"""WITH {MACRO_SQL} SELECT CAST(day AS VARCHAR) AS day, round(hy - ig, 4) + 0 AS credit_spread, round(hy / CASE WHEN
  ig = 0 THEN 1 ELSE ig END, 4) AS hy_ig_ratio, round(coalesce(dgs10 - lag(dgs10, 5) OVER w, 0), 4) + 0 AS yield_curve_velocity,
  round(coalesce(stress - lag(stress) OVER w, 0), 4) + 0 AS stress_change, round(exp(-(day(day) % 9) / 5.0), 4)
  AS meeting_proximity FROM m WINDOW w AS (ORDER BY day)""")
def macro_credit(spark, d):
    m, w = _macro(spark, d)
    c = F.col
    return rounded(m.select("day", *[v.alias(k) for k, v in M.credit(c("hy"), c("ig"), c("dgs10"), c("stress"), F.dayofmonth("day") % 9, w).items()]))


@query(f"""WITH {DAILY}, x AS (SELECT flag, day, v, {_full('avg(v) $', 'v', 4, DAYS)} AS sma4, lag(v, 4) {W_DAY} AS b, {_full('avg(v) $', 'v', 20, DAYS)}
  AS m, {_full('stddev_samp(v) $', 'v', 20, DAYS)} AS s, {_full('quantile_cont(v, 0.9) $', 'v', 60, DAYS)} AS p
  FROM daily)
  SELECT flag, CAST(day AS VARCHAR) AS day, round(sma4, 6) AS sma4, round(v / sma4 - 1, 4) + 0 AS vs_sma4, round((v
  - b) / nullif(b, 0) * 100, 3) AS change4, round((v - m) / s, 4) + 0 AS z20, CASE WHEN v > p THEN 1e0 ELSE 0 END
  AS stressed FROM x""")
def macro_momentum(spark, d):
    x, w = _days(spark, d)
    x = x.select("flag", F.col("day").cast("string").alias("day"), *[v.alias(k) for k, v in M.momentum(F.col("v"), w).items()])
    return x.select("flag", "day", F.round("sma4", 6).alias("sma4"), (F.round("vs_sma4", 4) + 0.0).alias("vs_sma4"), F.round("change4", 3).alias("change4"), (F.round("z20", 4) + 0.0).alias("z20"), "stressed")


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day FROM lineitem), f AS (SELECT DISTINCT
  l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40),
  p AS (SELECT d.*, (SELECT min(f.day) FROM f WHERE f.flag = d.flag AND f.day > d.day) AS n, (SELECT max(f.day)
  FROM f WHERE f.flag = d.flag AND f.day <= d.day) AS l FROM d)
  SELECT flag, CAST(day AS VARCHAR) AS day, CAST(coalesce(n - day, 90) AS INTEGER) AS days_to, CAST(coalesce(day
  - l, 90) AS INTEGER) AS days_since, coalesce(n - day <= 3, false) OR coalesce(day - l <= 3, false) AS is_near
  FROM p""")
def meeting_distance(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"), "l_linenumber", "l_quantity")
    out = M.meetings(x.select("flag", "day").distinct(), x.where("l_linenumber = 7 and l_quantity > 40"), "flag", "day")
    return rounded(out.select("flag", "day", "days_to", "days_since", "is_near"))


@query("""WITH v AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders WHERE isodow(o_orderdate)
  < 6 GROUP BY 1), q AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_tax) AS tax FROM lineitem WHERE l_linenumber
  = 5 GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round(value, 2) AS value, round(tax, 6) AS tax FROM v LEFT
  JOIN q USING (day)""")
def dates_left_join(spark, d):
    v = t(spark, d, "orders").where("weekday(o_orderdate) < 5").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("value"))
    q = t(spark, d, "lineitem").where("l_linenumber = 5").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_tax").alias("tax"))
    return v.join(q, "day", "left").select(F.col("day").cast("string").alias("day"), F.round("value", 2).alias("value"), F.round("tax", 6).alias("tax"))


# --- samples ----------------------------------------------------------------------------------------------------------

VALUES = "v AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1), n AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)"


def _target(h: int) -> str:
    return f"(SELECT b.value FROM v b WHERE b.day BETWEEN a.day + {h} - 9 AND a.day + {h} + 9 ORDER BY abs(b.day - (a.day + {h})), b.day DESC LIMIT 1)"


def _anchors(spark, d) -> DataFrame:
    v = t(spark, d, "orders").where("weekday(o_orderdate) < 5").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("value"))
    dates = t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return P.anchors(v, dates, "day", [1, 7, 15, 30], 10)


ANCHORS = f"""{VALUES}, w AS (SELECT day, list(day) OVER (ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS win FROM n), a AS (SELECT w.day, win, value FROM w JOIN v ON v.day = w.day WHERE len(win) = 10),
  t AS (SELECT day, win, value, {', '.join(f'{_target(h)} AS t{h}' for h in (1, 7, 15, 30))} FROM a), k AS (SELECT * FROM t WHERE t1 IS NOT NULL)"""


@query(f"WITH {ANCHORS} SELECT CAST(day AS VARCHAR) AS day, CAST(win[1] AS VARCHAR) AS first_day, len(win) AS days, " + ", ".join(f"round(coalesce(t{h} - value, 0), 2) + 0 AS change_{h}, CASE WHEN t{h} IS NULL THEN 0e0 ELSE 1 END AS mask_{h}" for h in (1, 7, 15, 30)) + " FROM k")
def sample_anchors(spark, d):
    a = _anchors(spark, d)
    changed = [c for h in (1, 7, 15, 30) for c in ((F.round(f"change_{h}", 2) + 0.0).alias(f"change_{h}"), F.col(f"mask_{h}"))]
    return a.select(F.col("day").cast("string").alias("day"), F.col("window")[0].cast("string").alias("first_day"), F.size("window").cast("long").alias("days"), *changed)


@query(f"WITH {ANCHORS} " + " UNION ALL ".join(f"SELECT {h} AS horizon, round(100.0 * avg(CASE WHEN t{h} IS NULL THEN 0 ELSE 1 END), 4) AS coverage, round(min(t{h} - value), 2) AS least, round(max(t{h} - value), 2) AS most FROM k" for h in (1, 7, 15, 30)))
def mask_coverage(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"mask_{h}").alias("mask"), F.col(f"change_{h}").alias("change")) for h in (1, 7, 15, 30)]))
    x = _anchors(spark, d).select(each.alias("x")).select("x.*")
    shown = F.when(F.col("mask") == 1, F.col("change"))
    return x.groupBy("horizon").agg(F.round(F.avg("mask") * 100, 4).alias("coverage"), F.round(F.min(shown), 2).alias("least"), F.round(F.max(shown), 2).alias("most"))


EVENTS = "ev AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type, value AS actual_z, user_id % 4 AS impact, (hour(ts) * 60 + minute(ts)) / 1440.0 AS tod FROM events), an AS (SELECT DISTINCT day AS anchor FROM ev WHERE day(day) % 5 = 0)"


def _calendar(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    ev = e.select("event_id", F.to_date("ts").alias("day"), F.col("value").alias("actual_z"), (F.col("user_id") % 4).alias("impact"), S.time_of_day(F.col("ts")).alias("tod"))
    return P.calendar(ev.where("day(day) % 5 = 0").select("day").distinct(), ev, "day", 3, 4)


@query(f"""WITH {EVENTS} SELECT CAST(anchor AS VARCHAR) AS anchor, event_id, round((day - anchor) / 15.0, 6) + 0 AS days_until,
  day > anchor AS is_future, round(CASE WHEN day > anchor THEN 0 ELSE actual_z END, 4) AS actual_z, CASE WHEN day
  > anchor THEN 0e0 ELSE 1 END AS has_actual, round(impact / 3.0, 6) AS impact, round(tod, 6) AS tod
  FROM an JOIN ev ON day BETWEEN anchor - 2 AND anchor + 4""")
def forward_calendar(spark, d):
    c = _calendar(spark, d).withColumns({"has_actual": F.lit(1.0), "impact": F.col("impact") / 3.0, "tod": S.day_share(F.col("tod"))})
    v = P.masked_vector(["actual_z", "has_actual", "impact", "tod"], {"actual_z", "has_actual"}, F.col("is_future"))
    c = c.withColumn("v", v)
    return c.select(F.col("anchor").cast("string").alias("anchor"), "event_id", (F.round(F.col("days_until") / 15.0, 6) + 0.0).alias("days_until"), "is_future", F.round(F.col("v")[0], 4).alias("actual_z"), F.col("v")[1].alias("has_actual"), F.round(F.col("v")[2], 6).alias("impact"), F.round(F.col("v")[3], 6).alias("tod"))


@query(f"""WITH {EVENTS}, g AS (SELECT anchor, count(*) AS n, CAST(sum(impact) AS DOUBLE) AS total FROM an JOIN ev ON day
  BETWEEN anchor - 2 AND anchor + 4 GROUP BY 1), m AS (SELECT max(n) AS longest FROM g) SELECT CAST(anchor AS VARCHAR)
  AS anchor, longest AS length, n AS ones, total FROM g, m""")
def padded_sequences(spark, d):
    """Every anchor's events as vectors, padded to the longest of its batch of anchors."""
    c = _calendar(spark, d)
    g = c.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col("impact").cast("double").alias("i"), "tod"))), lambda e: F.array(e.i, e.tod)).alias("v"))
    longest = g.agg(F.max(F.size("v")).alias("length"))  # one row
    full, mask = P.padded(F.col("v"), F.col("length"), 2)
    x = g.join(F.broadcast(longest)).withColumns({"full": full, "mask": mask})
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return x.select(F.col("anchor").cast("string").alias("anchor"), F.size("full").cast("long").alias("length"), add(F.col("mask")).cast("long").alias("ones"), F.round(add(F.transform("full", lambda e: e[0])), 4).alias("total"))


# --- cleaning and time ------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(ts AS VARCHAR) AS ts, round((hour(ts) * 60 + minute(ts)) / 1440.0, 6) AS time_of_day, CAST(hour(ts)
  * 60 + minute(ts) - 570 AS INTEGER) AS minute_of_session, round(sin(epoch(date_trunc('second', ts)) % 86400 *
  exp(-2 * ln(10000.0) / 4)), 5) + 0 AS sine, round(cos(epoch(date_trunc('second', ts)) % 86400 * exp(-1 * ln(10000.0)
  / 4)), 5) + 0 AS cosine FROM events WHERE event_id % 3 <> 0""")
def event_times(spark, d):
    """Times kept as nanoseconds, with zero for unknown ones, back to timestamps and their encodings."""
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))
    e = K.positive_times(e, "ns").withColumn("at", S.from_epoch_ns(F.col("ns")))
    code = S.time_encoding(F.unix_seconds("at"), 8)
    e = e.withColumn("code", code)
    at = F.col("at")
    return e.select("event_id", at.cast("timestamp_ntz").cast("string").alias("ts"), F.round(S.time_of_day(at), 6).alias("time_of_day"), S.minute_of_session(at).alias("minute_of_session"), (F.round(F.col("code")[2], 5) + 0.0).alias("sine"), (F.round(F.col("code")[5], 5) + 0.0).alias("cosine"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate + to_minutes(CASE WHEN o_orderkey
  % 3 = 0 THEN o_orderkey % 1440 ELSE 0 END) END AS VARCHAR) AS at FROM orders""")
def parse_times(spark, d):
    """Day and time texts, ISO dates, and texts that can't be read."""
    k, date, minutes = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderkey") % 1440
    day = F.when(k % 3 == 0, F.date_format(date, "yyyy/MM/dd")).when(k % 3 == 1, F.date_format(date, "yyyy-MM-dd")).otherwise("soon")
    time = F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)
    x = t(spark, d, "orders").select("o_orderkey", day.alias("day"), F.when(k % 3 == 0, time).alias("time"))
    return x.select("o_orderkey", S.parse_time(F.col("day"), F.col("time")).cast("timestamp_ntz").cast("string").alias("at"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 3 = 0
  THEN NULL WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 2 = 0 THEN
  p_name END AS name FROM part) SELECT p_partkey, size, round(price, 2) AS price, name IS NOT NULL AND price IS
  NOT NULL AS whole, CASE WHEN price IS NULL THEN 0 ELSE round(price, 2) END AS filled FROM x WHERE size IS NOT
  NULL AND (price IS NOT NULL OR name IS NOT NULL)""")
def cleaned_rows(spark, d):
    k = F.col("p_partkey")
    price = F.when(k % 3 == 0, None).when(k % 5 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice"))
    x = t(spark, d, "part").select("p_partkey", F.when(k % 7 != 0, F.col("p_size")).alias("size"), S.finite(price).alias("price"), F.when(k % 2 == 0, F.col("p_name")).alias("name"))
    x = K.not_empty(K.with_keys(x, ["size"]), ["price", "name"])
    whole = K.not_empty(x, ["price", "name"], whole=True).select("p_partkey", F.lit(True).alias("whole"))
    x = x.join(whole, "p_partkey", "left").withColumns({"whole": F.coalesce("whole", F.lit(False)), "filled": F.round(S.clean(F.col("price")), 2)})
    return x.select("p_partkey", "size", F.round("price", 2).alias("price"), "whole", "filled")


@query("SELECT p_partkey, round(p_retailprice, 2) AS close, 0e0 AS vwap, p_size FROM part")
def contract_columns(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_retailprice", "close")
    price = K.first_available(p, ["price", "close", "last"])
    return K.to_contract(p.withColumn("close", F.round(price, 2)), ["p_partkey", "close", "vwap", "p_size"], fill=True)


# --- windows, vectors, gates ------------------------------------------------------------------------------------------


@query(f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY tick_id) AS i FROM ticks) SELECT
  a.ticker, a.tick_id, CASE WHEN a.i >= 50 THEN round(count(CASE WHEN b.price <= a.price THEN 1 END) / 50.0, 4)
  END AS pct FROM n a JOIN n b ON a.ticker = b.ticker AND b.i BETWEEN a.i - 49 AND a.i GROUP BY 1, 2, a.i""")
def percentile_long(spark, d):
    x = ticks(spark, d).select("ticker", "tick_id", "price", F.floor(F.col("tick_id") / 4096).alias("cell"))
    return rounded(R.percentile_of_long(x, "price", ["ticker"], "cell", ["tick_id"], 50, "pct"))


@query(f"""WITH {BARS}, m AS (SELECT ticker, avg(close) AS m, stddev_pop(close) + 1e-8 AS s FROM agg WHERE trade_count > 12
  GROUP BY 1) SELECT a.ticker, CAST(bar AS VARCHAR) AS bar, round(CASE WHEN trade_count > 12 THEN (close - m) /
  s ELSE 0 END, 4) + 0 AS z FROM agg a LEFT JOIN m ON m.ticker = a.ticker""")
def masked_zscore(spark, d):
    b = B.bars(ticks(spark, d), "6 hours")
    return rounded(b.select("ticker", "bar", R.masked_zscore(F.col("close"), F.col("trade_count") > 12, Window.partitionBy("ticker")).alias("z")))


@query(f"""WITH {BARS} SELECT ticker, round(arg_max(close, bar), 4) AS last, round(avg(close), 4) AS mean, round(sum(exp(close
  / 100) * close) / sum(exp(close / 100)), 4) AS attended FROM agg GROUP BY 1""")
def sequence_pooling(spark, d):
    b, c = B.bars(ticks(spark, d), "6 hours"), F.col("close")
    weight = F.exp(c / 100)
    return rounded(b.groupBy("ticker").agg(F.max_by("close", "bar").alias("last"), S.exact_mean(c).alias("mean"), (F.sum(weight * c) / F.sum(weight)).alias("attended")))


@query("""SELECT p_partkey, round(2 * p_size + p_retailprice / 1000, 4) AS film, round(g * p_size + (1 - g) * p_retailprice
  / 100, 4) AS gated, round(x / (1 + exp(-x)), 5) AS silu, round(least(greatest(x, -1), 2), 4) AS clipped FROM
  (SELECT *, 1 / (1 + exp(-(p_size - 25) / 10.0)) AS g, (p_size - 25) / 10.0 AS x FROM part)""")
def gates(spark, d):
    size, price, x = F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_size") - 25) / 10.0
    return t(spark, d, "part").select("p_partkey", F.round(S.film(size, F.lit(2.0), price / 1000), 4).alias("film"), F.round(S.gated(S.sigmoid(x), size, price / 100), 4).alias("gated"), F.round(S.silu(x), 5).alias("silu"), F.round(S.clip(x, -1, 2), 4).alias("clipped"))


@query("""SELECT label, count(*) AS rows, CAST(min(len(embedding)) AS BIGINT) AS width, round(sum(list_sum(list_transform(embedding[1:8],
  lambda x: CAST(x AS DOUBLE)))), 4) + 0 AS head, round(sum(list_sum(list_transform(embedding[9:], lambda x: CAST(x
  AS DOUBLE)))), 4) + 0 AS tail, CAST(arg_min(vec_id, vec_id) AS BIGINT) AS first_id FROM embeddings GROUP BY 1""")
def embedding_matrix(spark, d):
    """A label's vectors in 16 stacks, so that no group is gathered whole; head and tail are slices of each."""
    e = t(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    stacked = e.groupBy("label", F.floor(F.col("vec_id") / 4096).alias("stack")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("m"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    over = lambda part: add(F.transform("m", lambda r: add(part(r.v))))
    x = stacked.select("label", "m", over(lambda v: F.slice(v, 1, 8)).alias("h"), over(lambda v: F.slice(v, F.lit(9), F.greatest(F.size(v) - 8, F.lit(0)))).alias("t"))
    out = x.groupBy("label").agg(F.sum(F.size("m")).alias("rows"), F.min(F.size(F.element_at("m", 1).v)).cast("long").alias("width"), F.sum("h").alias("head"), F.sum("t").alias("tail"), F.min(F.element_at("m", 1).vec_id).alias("first_id"))
    return rounded(out)


@query("""WITH c AS (SELECT l_returnflag AS flag, l_shipdate AS day, sum(l_quantity) / 1000 AS x, sum(l_tax) / 100 AS decay
  FROM lineitem GROUP BY 1, 2), k AS (SELECT flag, date_trunc('month', day) AS chunk, exp(-sum(decay)) AS a, sum(x)
  AS b, row_number() OVER (PARTITION BY flag ORDER BY date_trunc('month', day)) AS n FROM c GROUP BY 1, 2), r AS
  (SELECT a.flag, a.chunk, coalesce(sum(b.b * (SELECT coalesce(product(m.a), 1) FROM k m WHERE m.flag = a.flag
  AND m.n > b.n AND m.n < a.n)), 0) AS state FROM k a LEFT JOIN k b ON b.flag = a.flag AND b.n < a.n GROUP BY 1,
  2) SELECT flag, CAST(CAST(chunk AS DATE) AS VARCHAR) AS chunk, round(state, 4) AS state FROM r""")
def chunk_states(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day")).agg((F.sum("l_quantity") / 1000).alias("x"), (-F.sum("l_tax") / 100).alias("decay"))
    return rounded(Q.chunk_sums(x.withColumn("chunk", F.trunc("day", "MM")), ["flag"], "chunk", "x", "decay", "state"))


# --- losses and summaries ---------------------------------------------------------------------------------------------

_HUBER = "(CASE WHEN abs({0}) <= 0.25 THEN 0.5 * {0} * {0} ELSE 0.25 * (abs({0}) - 0.125) END)"


@query(f"""WITH {PRED}, b AS (SELECT batch, sum(CASE WHEN mask THEN CASE WHEN abs(target) >= 4 THEN 5 WHEN abs(target) >=
  2 THEN 3 ELSE 1 END * {_HUBER.format('(pred - target)')} ELSE 0 END) / greatest(count(CASE WHEN mask THEN 1 END),
  1) AS main, avg({_HUBER.format('(pred / 2 - target)')}) AS a, avg({_HUBER.format('(0 - target)')}) AS z FROM
  p GROUP BY 1), l AS (SELECT batch, main, main + 0.3 * a + 0.3 * z AS loss FROM b) SELECT batch, round(main, 4)
  AS main, round(loss, 4) AS loss, round(avg(loss) OVER (ORDER BY batch), 4) AS running FROM l""")
def combined_loss(spark, d):
    p = _predictions(spark, d)
    e = lambda pred: S.huber(pred - F.col("target"))
    main = F.sum(F.when(F.col("mask"), S.spike_weight(F.col("target")) * e(F.col("pred"))).otherwise(0.0)) / F.greatest(F.count_if("mask"), F.lit(1))
    b = p.groupBy("batch").agg(main.alias("main"), F.avg(e(F.col("pred") / 2)).alias("a"), F.avg(e(F.lit(0.0))).alias("z"))
    b = b.withColumn("loss", F.col("main") + 0.3 * F.col("a") + 0.3 * F.col("z"))
    return rounded(b.select("batch", "main", "loss", F.avg("loss").over(Window.orderBy("batch")).alias("running")))  # a row a batch


@query(f"""WITH {PRED} SELECT horizon, round(sum(CASE WHEN mask THEN {_HUBER.format('(pred - target)')} ELSE 0 END) / greatest(count(CASE
  WHEN mask THEN 1 END), 1), 5) AS loss FROM p GROUP BY 1""")
def masked_huber(spark, d):
    loss = F.sum(F.when(F.col("mask"), S.huber(F.col("pred") - F.col("target"))).otherwise(0.0)) / F.greatest(F.count_if("mask"), F.lit(1))
    return rounded(_predictions(spark, d).groupBy("horizon").agg(loss.alias("loss")), 5)


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS least, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice,
  0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(max(l_extendedprice), 6) AS most
  FROM lineitem GROUP BY 1""")
def described(spark, d):
    x, rows = "l_extendedprice", t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = rows.groupBy("flag").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    middle = quantiles.exact_quantiles(rows, ["flag"], x, {f"q{int(100 * p)}": p for p in (0.25, 0.5, 0.75)}, few=4096)
    return rounded(O.matched(out, middle, ["flag"]).select("flag", "n", "mean", "std", "least", "q25", "q50", "q75", "most"), 6)


@query("SELECT o_orderpriority AS form, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, form LIMIT 3")
def top_n_by_count(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("form")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(3)


# --- sets and samples of keys -----------------------------------------------------------------------------------------

DATE_SETS = {"orders": ("orders", "o_orderdate"), "lines": ("lineitem", "l_shipdate"), "events": ("events", "ts")}


def _dates(spark, d, name: str) -> DataFrame:
    table, column = DATE_SETS[name]
    return t(spark, d, table).select(F.to_date(column).alias("day"))


@query("SELECT CAST(day AS VARCHAR) AS day FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def dates_in_both(spark, d):
    return rounded(_dates(spark, d, "orders").intersect(_dates(spark, d, "lines")))


@query("""SELECT CAST(day AS VARCHAR) AS day FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate
  AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events UNION SELECT DATE '1990-01-01' + CAST(p_size
  AS INTEGER) FROM part)""")
def dates_in_any(spark, d):
    more = t(spark, d, "part").select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_size")).alias("day"))
    return rounded(_dates(spark, d, "orders").union(_dates(spark, d, "lines")).union(_dates(spark, d, "events")).union(more).distinct())


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day
  FROM lineitem)) SELECT CAST(day AS VARCHAR) AS day, n FROM x WHERE (n - 1) % 7 = 0""")
def every_seventh_file(spark, d):
    """A systematic sample of files: the operator, not a cut of the table."""
    x = _dates(spark, d, "lines").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))  # a row a file
    return x.where("(n - 1) % 7 = 0").select(F.col("day").cast("string").alias("day"), F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey, left(md5('7|' || o_orderkey), 2) AS cell, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS place FROM orders")
def seeded_shuffle(spark, d):
    """A permutation that a seed decides: places by hash, counted in 16 million cells, of which one holds few rows at any size."""
    h = F.md5(F.concat(F.lit("7|"), F.col("o_orderkey")).cast("binary"))
    x = t(spark, d, "orders").select("o_orderkey", h.alias("h"), F.substring(h, 1, 2).alias("cell"), F.conv(F.substring(h, 1, 6), 16, 10).cast("long").alias("at"), F.lit(0).alias("all"))
    return L.numbered(x, ["all"], "at", ["h", "o_orderkey"], "place").select("o_orderkey", "cell", "place")


@query("""SELECT source, id, CAST(ts AS VARCHAR) AS ts, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, source, id) AS INTEGER) AS nth FROM (
  SELECT 0 AS source, event_id AS id, ts FROM events UNION ALL SELECT 1, o_orderkey, o_orderdate FROM orders UNION
  ALL SELECT 2, l_orderkey * 10 + l_linenumber, l_shipdate FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate
  FROM lineitem))""")
def three_streams(spark, d):
    a = t(spark, d, "events").select(F.lit(0).alias("source"), F.col("event_id").alias("id"), "ts")
    b = t(spark, d, "orders").select(F.lit(1).alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    c = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct().select(F.lit(2).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"))
    u = a.unionByName(b).unionByName(c)
    return u.select("source", "id", F.col("ts").cast("string").alias("ts"), F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "source", "id")).alias("nth"))


# --- files ------------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(o_totalprice),
  2) AS total FROM orders WHERE date_trunc('month', o_orderdate) BETWEEN DATE '1996-03-01' AND DATE '1997-11-30'
  GROUP BY 1""")
def daily_files(spark, d):
    """Orders as a folder a day (their month's first), written in two runs of which the second skips what is there; a range of days read back by path."""
    folder = shared_folder(spark)
    o = t(spark, d, "orders").withColumn("date", F.trunc("o_orderdate", "MM"))
    sinks.write_days(o.where("date < '1998-05-01'"), folder)
    sinks.write_days(o, folder)
    x = files.daily_parquet(spark, folder, "1996-03-01", "1997-11-30", nested=True)
    return x.groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT year(o_orderdate) AS year, count(*) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day,
  round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1996-11-15' AND o_orderdate < DATE
  '1997-02-16' GROUP BY 1""")
def yearly_files(spark, d):
    """A half-open range of whole days on stored nanoseconds, over one file a year."""
    folder = shared_folder(spark)
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    t(spark, d, "orders").select("o_orderkey", "o_totalprice", ns.alias("ns"), F.year("o_orderdate").alias("year")).write.partitionBy("year").parquet(folder)
    x = files.time_range(spark.read.parquet(folder), "ns", "1996-11-15", "1997-02-15")
    day = F.to_date(S.from_epoch_ns(F.col("ns")))
    return x.groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.min(day).cast("string").alias("first_day"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_suppkey AS id, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier WHERE s_suppkey % 4 <> 0")
def csv_files(spark, d):
    """CSV with a header, columns by name; lines with too many fields left out."""
    folder = shared_folder(spark)
    s = t(spark, d, "supplier")
    line = F.concat_ws(",", F.col("s_suppkey"), F.col("s_name"), F.lit("x"), F.round("s_acctbal", 2))
    lines = s.select(F.when(F.col("s_suppkey") % 4 == 0, F.concat(line, F.lit(",more"))).otherwise(line).alias("value"))

    def with_header(parts):
        import pandas as pd

        yield pd.DataFrame({"value": ["id,name,other,balance"]})
        yield from parts

    lines.mapInPandas(with_header, "value string").write.text(folder)
    return files.csv_columns(spark, folder, {"id": "bigint", "name": "string", "balance": "double"}, skip_long_lines=True)


@query("SELECT s_suppkey AS id, round(s_acctbal, 2) AS balance FROM supplier WHERE s_nationkey IN (1, 5, 7)")
def headerless_in_list(spark, d):
    """CSV without a header under given names, kept where a key stands in a list file."""
    folder = shared_folder(spark)
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("balance"))
    s.write.csv(f"{folder}/rows")
    spark.createDataFrame([("1",), (" 5 ",), ("",), ("7",)], "value string").coalesce(1).write.text(f"{folder}/list")
    x = files.csv_headerless(spark, f"{folder}/rows", "id bigint, nation string, balance double")
    return files.in_list(x, "nation", f"{folder}/list").select("id", "balance")


@query("SELECT p_partkey, p_size * 2 AS p_size, round(p_retailprice, 2) AS price FROM part")
def rewritten_unit(spark, d):
    """A column's unit changed in a new version of a table, which another session reads by the table's place; of candidates the first that exists counts."""
    folder = shared_folder(spark)
    sinks.published(t(spark, d, "part"), {}, f"{folder}/parts")
    sinks.published(sinks.current(spark, f"{folder}/parts"), {"p_size": F.col("p_size") * 2}, f"{folder}/parts")
    held = sinks.current(spark.newSession(), f"{folder}/parts").inputFiles()[0].rsplit("/", 1)[0]
    x = files.optional_parquet(spark, [f"{folder}/missing", held, f"{d}/part.parquet"], ["p_partkey", "p_size", "p_retailprice", "absent"])
    return x.select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("price"))


@query("""SELECT flag, CAST(day AS VARCHAR) AS day, round(v, 2) AS v FROM (SELECT l_returnflag AS flag, CAST(l_shipdate AS
  DATE) AS day, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) ORDER BY day, flag LIMIT 100""")
def first_hundred(spark, d):
    """The summary that a run leaves behind: the first hundred rows by day, through a CSV file."""
    folder = shared_folder(spark)
    x = daily(spark, d).orderBy("day", "flag").limit(100).select("flag", F.col("day").cast("string").alias("day"), F.round("v", 2).alias("v"))
    sinks.append_csv(x.coalesce(1), folder, anew=True)
    return files.csv_columns(spark, folder, {"flag": "string", "day": "string", "v": "double"})


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1")
def store_listing(spark, d):
    """A listing of a store's files by year, no content read; years from the paths, bytes as the store gives them."""
    folder = shared_folder(spark)
    t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("line")).write.partitionBy("year").text(folder)
    keys = files.listing(spark, folder, "*.txt").withColumn("key", F.regexp_replace("key", "year=", ""))
    x = files.of_years(keys, 1997, 2100, keep_unknown=False).withColumn("year", S.path_year(F.col("key")))
    return x.groupBy("year").agg(F.sum("size").alias("bytes"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def statistics_file(spark, d):
    """Statistics of a run: one Parquet file, then JSON lines, read back."""
    folder = shared_folder(spark)
    x = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    sinks.write_one(x, f"{folder}/one")
    sinks.write_statistics(spark.read.parquet(f"{folder}/one"), f"{folder}/json")
    return spark.read.schema("priority string, n bigint, mean double").json(f"{folder}/json")


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS region FROM nation")
def concatenated_files(spark, d):
    """Two files of which one lacks a column."""
    folder, n = shared_folder(spark), t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    n.where("id % 2 = 0").write.parquet(f"{folder}/even")
    n.where("id % 2 = 1").drop("region").write.parquet(f"{folder}/odd")
    return files.concatenated(spark, [f"{folder}/even", f"{folder}/odd"])


@query("""SELECT coalesce(s_nationkey, n_nationkey) AS nation, n_name AS name, round(balance, 2) AS balance FROM nation FULL
  JOIN (SELECT s_nationkey, sum(s_acctbal) AS balance FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def optional_sources(spark, d):
    """Sources by configuration: two of three exist; what is there is joined on the key."""
    folder = shared_folder(spark)
    t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("s_acctbal").alias("balance")).write.parquet(f"{folder}/balances")
    t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), "n_regionkey").write.parquet(f"{folder}/names")
    found = files.optional_sources(spark, {"names": ([f"{folder}/old", f"{folder}/names"], ["nation", "name", "motto"]), "flags": ([f"{folder}/flags"], ["nation", "flag"]), "balances": ([f"{folder}/balances"], ["nation", "balance"])})
    return rounded(K.outer_all(list(found.values()), ["nation"]), 2)


@query("""SELECT o_orderkey AS id, CAST(year(o_orderdate) AS VARCHAR) || '-' || o_orderkey || '.parquet' AS name FROM orders
  WHERE year(o_orderdate) IN (1996, 1998)""")
def files_of_years(spark, d):
    """The fresh index of a store's files, kept to the names of two years."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("news/"), F.year("o_orderdate"), F.lit("-"), "o_orderkey", F.lit(".parquet")).alias("key"))
    held = files.index_or_listing(o, o.where("false"), "2024-01-01", "2024-01-16")
    return files.of_patterns(files.with_prefix(held, ["news/", "options/"]), ["1996-*", "1998-*"]).select("id", F.substring_index("key", "/", -1).alias("name"))


@query(f"""WITH {DAILY}, n AS (SELECT flag, day, v / 1e5 AS v, row_number() {W_DAY} AS i FROM daily), c AS (SELECT flag, day,
  0.5 * v + 0.3 * CASE WHEN i > 1 THEN lag(v, 1) {W_DAY} ELSE 2 END + 0.2 * CASE WHEN i > 2 THEN lag(v, 2) {W_DAY}
  WHEN i = 2 THEN 2 ELSE 1 END AS x FROM n) SELECT flag, CAST(day AS VARCHAR) AS day, round(x / (1 + exp(-x)),
  6) AS conv FROM c""")
def conv_with_state(spark, d):
    """A causal convolution that goes on from two earlier values, through the gate x * sigmoid(x)."""
    x, w = _days(spark, d)
    c = x.withColumn("v", F.col("v") / 1e5).select("flag", "day", Q.causal_conv("v", [0.5, 0.3, 0.2], w, [1.0, 2.0]).alias("x"))
    return rounded(c.select("flag", "day", S.silu(F.col("x")).alias("conv")), 6)


# --- streams ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {TICKS}, w AS (SELECT ticker, price, time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(k AS INTEGER)) AS
  s FROM ticks, range(6) r(k)) SELECT ticker, CAST(s AS VARCHAR) AS bar, count(*) AS n, round(max(price), 4) AS
  high FROM w GROUP BY 1, 2""")
def stream_sliding(spark, d):
    """Windows of six hours that start every hour."""
    x = streams.sliding(_tick_stream(spark, d), "6 hours", "1 hour", "1 hour")
    return rounded(drained(x, "update", ["ticker", "bar"], "n"))


@query(f"""WITH {TICKS}, n AS (SELECT ticker, tick_id, price, row_number() OVER (PARTITION BY ticker ORDER BY ts, tick_id)
  AS i FROM ticks) SELECT ticker, tick_id, round(exp(-0.01 * i) * sum(exp(0.01 * i) * price) OVER (PARTITION BY
  ticker ORDER BY i ROWS UNBOUNDED PRECEDING), 3) AS h FROM n""")
def stream_scan(spark, d):
    """The scan h = exp(-0.01) * h + price over a stream, whose state is one number a ticker."""
    x = _tick_stream(spark, d).select("ticker", "ts", "tick_id", "price")
    return drained(running.stream_scan(x, "ticker", ["ts", "tick_id"], "price", 0.01)).select("ticker", "tick_id", F.round("h", 3).alias("h"))


@query(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh
  FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker
  ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT ticker, CAST(min(ts) AS VARCHAR) AS start, CAST(max(ts)
  + INTERVAL '30 minutes' AS VARCHAR) AS end, count(*) AS n FROM s GROUP BY ticker, session""")
def stream_sessions(spark, d):
    """Runs of ticks less than half an hour apart, from a stream: a run is given out once the watermark has passed its end."""
    folder = shared_folder(spark)
    x = ticks(spark, d).select("ticker", F.col("ts").cast("timestamp").alias("ts"))
    x.write.parquet(f"{folder}/in")
    run = lambda: drained(streams.sessions(stream_of(spark, f"{folder}/in", x), "30 minutes", "1 hour"), folder=f"{folder}/out")
    run()
    spark.range(1).select(F.lit("end").alias("ticker"), F.lit("2100-01-01").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{folder}/in")
    return run().where("ticker != 'end'").select("ticker", F.col("start").cast("timestamp_ntz").cast("string").alias("start"), F.col("end").cast("timestamp_ntz").cast("string").alias("end"), "n")


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return streams.stream_ticks(spark, path, like.schema)
