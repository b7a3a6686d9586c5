"""The queries of the reference-side operators over the driver's tables, each with equal SQL.

Roles: events are ticks (event_type the ticker, value the price, props.k the volume), orders are filings (customer the
entity, market segment the sector), lineitem gives a daily series by ship date and option-like rows by order date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import bars as B
from ..operators import ordered as O
from ..operators import quantiles as N
from ..operators import rolling as R
from ..operators import scores as C
from ..operators import sequences as Q
from ..sources import files, filings as documents, sinks
from ..streaming import bars as streams
from ..streaming import state as running
from ..streaming.sinks import drained

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query_of(queries: dict, texts: dict[str, str]):
    """A decorator that enters a query under its name, with equal SQL where there is some."""
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return query


query = query_of(QUERIES, SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    volume = F.from_json("props", "k bigint").k.cast("double")
    return e.select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"), F.coalesce(volume, F.lit(0.0)).alias("volume"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_returnflag", "l_extendedprice", "l_quantity")
    return x.groupBy("l_returnflag", "day").agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("qty")).withColumnRenamed("l_returnflag", "flag")


def filings(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("filed")).agg(F.sum("o_totalprice").alias("revenue"))


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, times as text, so that summation order and time types don't show."""
    def one(c: str, kind: str):
        if kind in ("double", "float"):
            return (F.round(F.col(c), places) + 0.0).alias(c)
        return F.col(c).cast("string").alias(c) if kind in ("timestamp_ntz", "timestamp", "date") else F.col(c)

    return df.select(*[one(c, k) for c, k in df.dtypes])


TICKS = """ticks AS (SELECT event_type AS ticker, ts, event_id AS tick_id, value AS price, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0) AS volume FROM events)"""
BARS = TICKS + """, agg AS (
  SELECT ticker, time_bucket(INTERVAL '6 hours', ts) AS bar, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
    sum(volume) AS volume, count(*) AS trade_count, avg(price) AS price_mean, coalesce(stddev_samp(price), 0) AS price_std,
    CASE WHEN sum(volume) > 0 THEN sum(price * volume) / sum(volume) ELSE arg_max(price, (ts, tick_id)) END AS vwap
  FROM ticks GROUP BY 1, 2)"""
DAILY = """daily AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS v, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"""
FILINGS = """filings AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filed, sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2)"""


# --- bars -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round(open, 4) AS open, round(high, 4) AS high, round(low,
  4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, trade_count FROM agg""")
def bars_ohlcv(spark, d):
    return rounded(B.bars(ticks(spark, d), "6 hours").select("ticker", "bar", "open", "high", "low", "close", "volume", "trade_count"))


@query(f"""WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round(vwap, 7) + 0 AS vwap, round(price_mean, 7) + 0 AS
  price_mean, round(price_std, 7) + 0 AS price_std,
  round(high - low, 7) + 0 AS price_range, round(CASE WHEN open > 0 THEN (high - low) / open ELSE 0 END * 100, 7)
  + 0 AS price_range_pct, round(CASE WHEN trade_count > 0 THEN volume / trade_count ELSE 0 END, 7) + 0 AS avg_trade_size,
  round(close - vwap, 7) + 0 AS close_vs_vwap, round(high - vwap, 7) + 0 AS high_vs_vwap, round(low - vwap, 7) +
  0 AS low_vs_vwap, round(CASE WHEN open > 0 THEN (close - open) / open ELSE 0 END, 7) + 0 AS close_return,
  round(volume / (trade_count + 1), 7) + 0 AS volume_per_trade, round((high - low) / (low + 1e-8), 7) + 0 AS high_low_ratio,
  round((close - low) / (high - low + 1e-8), 7) + 0 AS close_position FROM agg""")
def bars_features(spark, d):
    b = B.derived(B.bars(ticks(spark, d), "6 hours"))
    names = "vwap price_mean price_std price_range price_range_pct avg_trade_size close_vs_vwap high_vs_vwap low_vs_vwap close_return volume_per_trade high_low_ratio close_position"
    return rounded(b.select("ticker", "bar", *names.split()), 7)


@query(f"""WITH {TICKS}, s AS (SELECT ticker, time_bucket(INTERVAL '6 hours', ts) AS bar, avg(price) AS m, stddev_samp(price)
  AS s, count(*) AS n FROM ticks GROUP BY 1, 2)
  SELECT s.ticker, CAST(bar AS VARCHAR) AS bar, round(CASE WHEN any_value(n) < 3 OR any_value(s) <= 1e-10 THEN 0
  ELSE avg(pow(price - m, 3)) / (pow(any_value(s), 3) + 1e-8) END, 4) AS price_skew
  FROM ticks t JOIN s ON s.ticker = t.ticker AND s.bar = time_bucket(INTERVAL '6 hours', t.ts) GROUP BY 1, 2""")
def bars_skew(spark, d):
    return rounded(B.bars(ticks(spark, d), "6 hours").select("ticker", "bar", "price_skew"))


@query("""WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), y AS (
  SELECT day, CAST(isodow(day) - 1 AS INTEGER) AS dow, CAST(date_trunc('month', day) AS DATE) AS m, CAST(date_trunc('month',
  day) + INTERVAL 1 MONTH AS DATE) AS m2 FROM x), z AS (
  SELECT *, m + CAST((4 - (isodow(m) - 1) + 7) % 7 + 14 AS INTEGER) AS f, m2 + CAST((4 - (isodow(m2) - 1) + 7) % 7 + 14 AS INTEGER) AS f2 FROM y)
  SELECT CAST(day AS VARCHAR) AS day, dow, CAST((4 - dow + 5) % 5 AS INTEGER) AS days_to_friday, dow = 4 AS is_friday,
  CAST(least(CASE WHEN day <= f THEN f - day ELSE f2 - day END, 30) AS INTEGER) AS days_to_expiry, day = f AS is_expiry
  FROM z""")
def bars_calendar(spark, d):
    x = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    day = F.col("day")
    return x.select(day.cast("string").alias("day"), F.weekday(day).alias("dow"), S.days_to_friday(day).alias("days_to_friday"), (F.weekday(day) == 4).alias("is_friday"), S.days_to_monthly_expiry(day).alias("days_to_expiry"), (day == S.third_friday(day)).alias("is_expiry"))


@query(f"""WITH {BARS}, a AS (SELECT ticker, sum(volume) AS raw FROM ticks GROUP BY 1), b AS (SELECT ticker, sum(volume) AS
  barred FROM agg GROUP BY 1) SELECT ticker, round(raw, 2) AS raw, round(barred, 2) AS barred, abs(raw - barred)
  > 0.01 AS differs FROM a JOIN b USING (ticker)""")
def bars_checksum(spark, d):
    x = ticks(spark, d)
    a, b = x.groupBy("ticker").agg(F.sum("volume").alias("raw")), B.bars(x, "6 hours").groupBy("ticker").agg(F.sum("volume").alias("barred"))
    return rounded(a.join(b, "ticker").withColumn("differs", F.abs(F.col("raw") - F.col("barred")) > 0.01), 2)


@query(f"""WITH {TICKS}, x AS (SELECT ticker, ts, lag(ts) OVER (PARTITION BY ticker ORDER BY tick_id) AS before FROM ticks)
  SELECT ticker, count(*) AS n, count(CASE WHEN ts <= before THEN 1 END) AS backwards FROM x GROUP BY 1""")
def bars_ts_monotonic(spark, d):
    x = ticks(spark, d).withColumn("cell", F.floor(F.col("tick_id") / 4096))
    x = O.lagged(x, ["ticker"], "cell", ["tick_id"], "ts", "before")
    return x.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("ts") <= F.col("before")).alias("backwards"))


@query(f"""WITH {BARS}, c AS (SELECT ticker, CAST(bar AS DATE) AS day, count(*) AS n FROM agg GROUP BY 1, 2) SELECT ticker,
  min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, count(CASE WHEN n < 4 THEN 1 END) AS short_days FROM
  c GROUP BY 1""")
def bars_per_key_stats(spark, d):
    c = B.bars(ticks(spark, d), "6 hours").groupBy("ticker", F.to_date("bar").alias("day")).agg(F.count("*").alias("n"))
    return rounded(c.groupBy("ticker").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count_if(F.col("n") < 4).alias("short_days")))


@query("""SELECT event_type AS ticker, count(*) AS n, count(CASE WHEN value IS NULL OR isnan(value) THEN 1 END) AS null_value,
  count(CASE WHEN value = 0 THEN 1 END) AS zero_value, count(CASE WHEN props IS NULL THEN 1 END) AS null_props,
  count(DISTINCT user_id) AS users, round(100.0 * avg(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END), 4) AS coverage FROM events GROUP BY 1""")
def null_audit(spark, d):
    v = F.col("value")
    return rounded(t(spark, d, "events").groupBy(F.col("event_type").alias("ticker")).agg(
        F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("null_value"), F.count_if(v == 0).alias("zero_value"), F.count_if(F.col("props").isNull()).alias("null_props"),
        F.countDistinct("user_id").alias("users"), (F.avg(v.isNotNull().cast("double")) * 100).alias("coverage")))


@query("""SELECT l_returnflag AS underlying, CAST(date_trunc('month', l_shipdate) AS VARCHAR) AS bar, round(sum(l_quantity),
  2) AS volume, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS call_volume,
  round(sum(l_extendedprice) / (sum(l_quantity) + 1e-8), 4) AS mean_premium, round(avg(l_discount), 6) AS iv_skew, round(max(l_tax), 6) AS most_tax,
  round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / (sum(CASE WHEN l_linestatus = 'O' THEN l_quantity
  ELSE 0 END) + 1), 4) AS put_call_ratio FROM lineitem GROUP BY 1, 2""")
def options_rollup(spark, d):
    q, call = F.col("l_quantity"), F.col("l_linestatus") == "O"
    put = F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(0.0))
    calls = F.sum(F.when(call, q).otherwise(0.0))
    x = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("underlying"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").cast("string").alias("bar"))
    return x.agg(F.round(F.sum(q), 2).alias("volume"), F.round(calls, 2).alias("call_volume"), F.round(F.sum("l_extendedprice") / (F.sum(q) + 1e-8), 4).alias("mean_premium"), F.round(F.avg("l_discount"), 6).alias("iv_skew"), F.round(F.max("l_tax"), 6).alias("most_tax"), F.round(put / (calls + 1), 4).alias("put_call_ratio"))


@query(f"""WITH {BARS} SELECT CAST(bar AS VARCHAR) AS bar, round(sum(volume), 4) AS volume, round(avg(close_ratio), 4) AS
  close_ratio FROM (SELECT *, close / open AS close_ratio FROM agg) GROUP BY 1""")
def name_rule_rollup(spark, d):
    b = B.bars(ticks(spark, d), "6 hours").withColumn("close_ratio", F.try_divide("close", "open"))
    return rounded(B.roll_up(b, ["bar"], ["volume", "close_ratio"]))


@query(f"WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round(coalesce(stddev_samp(close) OVER (PARTITION BY bar), 0), 4) AS dispersion FROM agg")
def ticker_dispersion(spark, d):
    b = B.bars(ticks(spark, d), "6 hours")
    return rounded(b.select("ticker", "bar", F.coalesce(F.stddev_samp("close").over(Window.partitionBy("bar")), F.lit(0.0)).alias("dispersion")))


# --- windows over one series ------------------------------------------------------------------------------------------

BY_BAR = "OVER (PARTITION BY ticker ORDER BY bar)"
BY_DAY = "OVER (PARTITION BY flag ORDER BY day)"


def _bars(spark, d) -> tuple[DataFrame, object]:
    return B.bars(ticks(spark, d), "6 hours"), R.series(["ticker"], ["bar"])


def _days(spark, d) -> tuple[DataFrame, object]:
    return daily(spark, d), R.series(["flag"], ["day"])


@query(f"""WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round(coalesce(close - lag(close, 10) {BY_BAR}, 0), 4)
  AS diff10, round(coalesce(volume - lag(volume, 30) {BY_BAR}, 0), 4) AS diff30 FROM agg""")
def lag_diff_zero(spark, d):
    b, w = _bars(spark, d)
    return rounded(b.select("ticker", "bar", R.lag_diff(F.col("close"), 10, w, 0.0).alias("diff10"), R.lag_diff(F.col("volume"), 30, w, 0.0).alias("diff30")))


@query(f"""WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round(close - lag(close, 15) {BY_BAR}, 4) AS velocity,
  round(close - 2 * lag(close, 15) {BY_BAR} + lag(close, 30) {BY_BAR}, 4) AS acceleration FROM agg""")
def velocity_accel(spark, d):
    b, w = _bars(spark, d)
    return rounded(b.select("ticker", "bar", R.lag_diff(F.col("close"), 15, w).alias("velocity"), R.acceleration(F.col("close"), 15, w).alias("acceleration")))


CUM = "OVER (PARTITION BY ticker ORDER BY bar ROWS UNBOUNDED PRECEDING)"
TICK_CUM = "OVER (PARTITION BY ticker ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING)"


def _cum(x: str) -> str:
    return f"(CASE WHEN count({x}) {CUM} < 2 THEN 0 ELSE ({x} - avg({x}) {CUM}) / sqrt(greatest(avg({x} * {x}) {CUM} - avg({x}) {CUM} * avg({x}) {CUM}, 1e-8)) END)"


@query(f"WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round({_cum('close')}, 4) AS z FROM agg")
def cumulative_zscore(spark, d):
    b, w = _bars(spark, d)
    return rounded(b.select("ticker", "bar", R.cumulative_zscore(F.col("close"), w).alias("z")))


@query(f"""WITH {BARS}, x AS (SELECT *, CAST(trade_count AS DOUBLE) AS tc FROM agg) SELECT ticker, CAST(bar AS VARCHAR) AS
  bar, round({_cum('price_std')} + {_cum('volume')} - {_cum('tc')}, 4) + 0 AS liquidity_stress FROM x""")
def liquidity_stress(spark, d):
    b, w = _bars(spark, d)
    z = lambda c: R.cumulative_zscore(F.col(c).cast("double"), w)
    return rounded(b.select("ticker", "bar", (z("price_std") + z("volume") - z("trade_count")).alias("liquidity_stress")))


def _full(f: str, x: str, k: int, by: str, least: int | None = None) -> str:
    w = f"OVER ({by} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {k if least is None else least} THEN {f.replace('$', w)} END)"


DAYS = "PARTITION BY flag ORDER BY day"
RETURNS = f"{DAILY}, r AS (SELECT *, ln(v / lag(v) {BY_DAY}) AS ret FROM daily)"


@query(f"WITH {RETURNS} SELECT flag, CAST(day AS VARCHAR) AS day, " + ", ".join(f"round(sqrt({_full('sum(ret * ret) $', 'ret', k, DAYS)}), 4) AS rv{k}, round(sqrt({_full('sum(ret * ret) $', 'ret', k, DAYS, max(1, k // 2))}), 4) AS part_rv{k}" for k in (3, 15, 60)) + " FROM r")
def rolling_rv(spark, d):
    x, w = _days(spark, d)
    x, r = x.withColumn("ret", R.log_return(F.col("v"), w)), F.col("ret")
    return rounded(x.select("flag", "day", *[c for k in (3, 15, 60) for c in (R.rolling_rv(r, k, w).alias(f"rv{k}"), R.rolling_rv(r, k, w, max(1, k // 2)).alias(f"part_rv{k}"))]))


@query(f"""WITH {DAILY} SELECT flag, CAST(day AS VARCHAR) AS day, round({_full('avg(qty) $', 'qty', 20, DAYS)}, 6) AS sma20,
  round({_full('avg(qty) $', 'qty', 200, DAYS, 50)}, 6) AS sma200 FROM daily""")
def rolling_sma(spark, d):
    x, w = _days(spark, d)
    v = F.col("qty")
    return rounded(x.select("flag", "day", R.rolling(F.avg(v), v, 20, w).alias("sma20"), R.rolling(F.avg(v), v, 200, w, 50).alias("sma200")), 6)


@query(f"""WITH {DAILY}, x AS (SELECT *, {_full('avg(v) $', 'v', 20, DAYS)} AS m, {_full('stddev_pop(v) $', 'v', 20, DAYS)}
  AS s FROM daily) SELECT flag, CAST(day AS VARCHAR) AS day, round(CASE WHEN s > 1e-8 THEN (v - m) / s END, 4)
  AS z FROM x""")
def rolling_zscore_pop(spark, d):
    x, w = _days(spark, d)
    return rounded(x.select("flag", "day", R.rolling_zscore(F.col("v"), 20, w).alias("z")))


@query(f"""WITH {DAILY}, n AS (SELECT *, row_number() {BY_DAY} AS i FROM daily) SELECT a.flag, CAST(a.day AS VARCHAR) AS day,
  CASE WHEN a.i >= 20 THEN round(count(CASE WHEN b.v <= a.v THEN 1 END) / 20.0, 4) END AS pct FROM n a JOIN n b
  ON a.flag = b.flag AND b.i BETWEEN a.i - 19 AND a.i GROUP BY a.flag, a.day, a.i""")
def rolling_percentile(spark, d):
    x, w = _days(spark, d)
    return rounded(x.select("flag", "day", R.rolling_percentile(F.col("v"), 20, w).alias("pct")))


@query(f"""WITH {DAILY}, x AS (SELECT *, {_full('quantile_cont(v, 0.9) $', 'v', 60, DAYS)} AS p FROM daily) SELECT flag, CAST(day
  AS VARCHAR) AS day, round(p, 4) AS p90, CASE WHEN p IS NOT NULL THEN v > p END AS stressed FROM x""")
def rolling_p90_flag(spark, d):
    x, w = _days(spark, d)
    v = F.col("v")
    return rounded(x.withColumn("p90", R.rolling(F.percentile(v, 0.9), v, 60, w)).select("flag", "day", "p90", (v > F.col("p90")).alias("stressed")), 4)


@query(f"""WITH {TICKS}, x AS (SELECT ticker, CAST(ts AS DATE) AS day, ts, tick_id, price, price - lag(price) OVER (PARTITION
  BY ticker, CAST(ts AS DATE) ORDER BY ts, tick_id) AS r FROM ticks), n AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY ts, tick_id) AS u, row_number() OVER (PARTITION
  BY ticker, day ORDER BY ts DESC, tick_id DESC) AS o FROM x), s AS (
  SELECT ticker, day, count(*) AS n, avg(CASE WHEN u <= 10 THEN r * r END) AS a, avg(CASE WHEN o <= 10 THEN r * r END) AS b FROM n GROUP BY 1, 2)
  SELECT ticker, CAST(day AS VARCHAR) AS day, n, round(CASE WHEN n < 20 OR b <= 1e-10 OR b IS NULL THEN 1 ELSE sqrt(a / b) END, 4) AS vol_skew FROM s""")
def intraday_vol_skew(spark, d):
    x = ticks(spark, d).withColumn("day", F.to_date("ts"))
    x = x.withColumn("r", R.lag_diff(F.col("price"), 1, R.series(["ticker", "day"], ["ts", "tick_id"])))
    x = R.with_first_last_ratio(x, "r", ["ticker", "day"], ["ts", "tick_id"], 10, 20, "vol_skew")
    return rounded(x.groupBy("ticker", "day").agg(F.count("*").alias("n"), F.first("vol_skew").alias("vol_skew")))


@query(f"""WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round((close - avg(close) OVER (PARTITION BY ticker)) /
  (stddev_pop(close) OVER (PARTITION BY ticker) + 1e-8), 4) AS z FROM agg""")
def sequence_zscore(spark, d):
    b, _ = _bars(spark, d)
    return rounded(b.select("ticker", "bar", R.zscore_of_all("close", ["ticker"]).alias("z")))


@query("""SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand,
  p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS pct FROM part""")
def rank_pct_average(spark, d):
    return rounded(t(spark, d, "part").select("p_partkey", R.percent_rank_average("p_size", ["p_brand"]).alias("pct")), 6)


RV = f"{TICKS}, r AS (SELECT ticker, CAST(ts AS DATE) AS day, ln(price / lag(price) OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts, tick_id)) AS r FROM ticks WHERE price > 0), rv AS (SELECT ticker, day, sqrt(sum(r * r)) AS daily_rv, count(*) AS n_ticks, count(r) AS n_returns FROM r GROUP BY 1, 2)"


def _daily_rv(spark, d):
    x = ticks(spark, d).where("price > 0").withColumn("day", F.to_date("ts"))
    r = x.withColumn("r", R.log_return(F.col("price"), R.series(["ticker", "day"], ["ts", "tick_id"])))
    return r.groupBy("ticker", "day").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("daily_rv"), F.count("*").alias("n_ticks"), F.count("r").alias("n_returns"))


@query(f"WITH {RV} SELECT ticker, CAST(day AS VARCHAR) AS day, round(daily_rv, 4) AS daily_rv, n_ticks, n_returns FROM rv")
def daily_rv(spark, d):
    return rounded(_daily_rv(spark, d))


@query(f"""WITH {RV} SELECT a.ticker, CAST(a.day AS VARCHAR) AS day, round(CASE WHEN count(b.daily_rv) >= 10 THEN sqrt(sum(b.daily_rv
  * b.daily_rv)) END, 4) AS forward_rv FROM rv a LEFT JOIN rv b ON a.ticker = b.ticker AND b.day > a.day AND b.day
  <= a.day + 30 GROUP BY 1, 2""")
def forward_rv_30d(spark, d):
    x = _daily_rv(spark, d).withColumn("n", F.unix_date("day"))
    w = Window.partitionBy("ticker").orderBy("n").rangeBetween(1, 30)
    v = F.col("daily_rv")
    return rounded(x.select("ticker", "day", F.when(F.count(v).over(w) >= 10, F.sqrt(F.sum(v * v).over(w))).alias("forward_rv")))


GAPS = f"{DAILY}, g AS (SELECT flag, day, CASE WHEN day(day) % 3 = 0 THEN v END AS v FROM daily)"


@query(f"""WITH {GAPS} SELECT flag, CAST(day AS VARCHAR) AS day, round(last_value(v IGNORE NULLS) OVER ({DAYS} ROWS UNBOUNDED
  PRECEDING), 2) AS forward, round(first_value(v IGNORE NULLS) OVER ({DAYS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED
  FOLLOWING), 2) AS backward FROM g""")
def ffill_bfill(spark, d):
    x, w = _days(spark, d)
    x = x.withColumn("v", F.when(F.dayofmonth("day") % 3 == 0, F.col("v")))
    return rounded(x.select("flag", "day", R.ffill(F.col("v"), w).alias("forward"), R.bfill(F.col("v"), w).alias("backward")), 2)


@query(f"WITH {DAILY} SELECT flag, CAST(day AS VARCHAR) AS day, round(lag(v) {BY_DAY}, 2) AS v, round(lag(qty) {BY_DAY}, 2) AS qty FROM daily")
def t_minus_1_shift(spark, d):
    x, w = _days(spark, d)
    return rounded(R.shift_all(x, ["v", "qty"], w), 2)


@query(f"""WITH {DAILY}, x AS (SELECT flag, day, v, lag(v, 12) {BY_DAY} AS b FROM daily) SELECT flag, CAST(day AS VARCHAR)
  AS day, round((v - b) / nullif(b, 0), 4) AS change12, round(CASE WHEN b > 1e5 THEN (v - b) / b END, 4) AS floored
  FROM x""")
def pct_change_yoy(spark, d):
    x, w = _days(spark, d)
    return rounded(x.select("flag", "day", R.pct_change(F.col("v"), 12, w).alias("change12"), R.pct_change(F.col("v"), 12, w, 1e5).alias("floored")))


# --- joins in time ----------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, max(l_tax) AS rate FROM lineitem WHERE
  l_linenumber = 7 GROUP BY 1, 2), a AS (SELECT DISTINCT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day
  FROM lineitem)
  SELECT a.flag, CAST(a.day AS VARCHAR) AS day, CAST(m.day AS VARCHAR) AS right_day, round(m.rate, 4) AS rate FROM
  a ASOF LEFT JOIN m ON a.flag = m.flag AND a.day >= m.day""")
def asof_backward(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"), "l_tax", "l_linenumber")
    m = x.where("l_linenumber = 7").groupBy("flag", "day").agg(F.max("l_tax").alias("rate"))
    return rounded(A.asof(x.select("flag", "day").distinct(), m, ["flag"], "day", ["rate"]))


@query("""WITH m AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, max(l_tax) AS rate FROM lineitem WHERE
  l_linenumber = 7 GROUP BY 1, 2), a AS (SELECT DISTINCT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day
  FROM lineitem)
  SELECT a.flag, CAST(a.day AS VARCHAR) AS day, CAST(m.day AS VARCHAR) AS right_day, CAST(least(m.day - a.day, 30)
  AS INTEGER) AS days_until FROM a ASOF LEFT JOIN m ON a.flag = m.flag AND a.day <= m.day""")
def asof_forward_event(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"), "l_tax", "l_linenumber")
    m = x.where("l_linenumber = 7").groupBy("flag", "day").agg(F.max("l_tax").alias("rate"))
    found = A.asof(x.select("flag", "day").distinct(), m, ["flag"], "day", ["rate"], forward=True)
    return found.select("flag", F.col("day").cast("string").alias("day"), F.col("right_day").cast("string").alias("right_day"), F.least(F.datediff("right_day", "day"), F.lit(30)).alias("days_until"))


@query("""WITH v AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1), x AS (
  SELECT a.day, b.day AS target_day, b.value AS target_value, row_number() OVER (PARTITION BY a.day ORDER BY abs(b.day
  - (a.day + 7)), b.day DESC) AS n FROM v a JOIN v b ON b.day BETWEEN a.day + 7 - 9 AND a.day + 7 + 9)
  SELECT CAST(v.day AS VARCHAR) AS day, round(v.value, 2) AS value, CAST(target_day AS VARCHAR) AS target_day, round(target_value,
  2) AS target_value FROM v LEFT JOIN x ON v.day = x.day AND x.n = 1""")
def nearest_horizon_target(spark, d):
    v = t(spark, d, "orders").where(F.weekday("o_orderdate") < 5).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("value"))
    return rounded(A.nearest_day(v, v, "day", 7), 2)


@query(f"""WITH {FILINGS}, dates AS (SELECT DISTINCT CAST(date_trunc('month', filed) AS DATE) AS day FROM filings), s AS (
  SELECT d.day, f.ticker, f.revenue, row_number() OVER (PARTITION BY d.day, f.ticker ORDER BY f.filed DESC) AS n
  FROM dates d JOIN filings f ON f.filed <= d.day AND f.filed >= d.day - 180)
  SELECT CAST(day AS VARCHAR) AS day, c_mktsegment AS sector, count(*) AS n_reported, round(sum(revenue), 2) AS revenue,
  round(avg(CASE WHEN revenue > 100000 THEN 100.0 ELSE 0 END), 4) AS pct_large FROM s JOIN customer ON c_custkey
  = ticker WHERE n = 1 GROUP BY 1, 2""")
def pit_sector_state(spark, d):
    f = filings(spark, d)
    dates = f.select(F.trunc("filed", "MM").alias("day")).distinct()
    held = A.state_at(dates, f, "ticker", "day", "filed")
    sector = t(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector"))
    out = held.join(sector, "ticker").groupBy("day", "sector").agg(F.count("*").alias("n_reported"), F.sum("revenue").alias("revenue"), F.avg(F.when(F.col("revenue") > 100000, 100.0).otherwise(0.0)).alias("pct_large"))
    return out.select(F.col("day").cast("string").alias("day"), "sector", "n_reported", F.round("revenue", 2).alias("revenue"), F.round("pct_large", 4).alias("pct_large"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, round(arg_max(o_totalprice, (o_orderdate,
  o_orderkey)), 2) AS last_price FROM orders GROUP BY 1""")
def latest_per_key(spark, d):
    order = F.struct("o_orderdate", "o_orderkey")
    return rounded(t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("last_order"), F.max_by("o_totalprice", order).alias("last_price")), 2)


@query(f"""WITH {FILINGS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY filed DESC) AS n FROM filings)
  SELECT c_mktsegment AS sector, round(sum(CASE WHEN n = 1 THEN revenue END), 2) AS cur, round(sum(CASE WHEN n =
  2 THEN revenue END), 2) AS prev, round((sum(CASE WHEN n = 1 THEN revenue END) - sum(CASE WHEN n = 2 THEN revenue
  END)) / nullif(sum(CASE WHEN n = 2 THEN revenue END), 0), 4) AS change FROM r JOIN customer ON c_custkey = ticker
  WHERE n <= 2 GROUP BY 1""")
def prev_curr_change(spark, d):
    r = filings(spark, d).withColumn("n", F.dense_rank().over(Window.partitionBy("ticker").orderBy(F.desc("filed")))).where("n <= 2")
    cur, prev = (F.sum(F.when(F.col("n") == i, F.col("revenue"))) for i in (1, 2))
    out = r.join(t(spark, d, "customer"), F.col("ticker") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("sector")).agg(cur.alias("cur"), prev.alias("prev"))
    return out.select("sector", F.round("cur", 2).alias("cur"), F.round("prev", 2).alias("prev"), F.round(F.try_divide(F.col("cur") - F.col("prev"), "prev"), 4).alias("change"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20")
def top_n_by_value(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("r")).orderBy(F.desc("r"), "o_custkey").limit(20).select("o_custkey", F.round("r", 2).alias("revenue"))


@query("SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS \"F\", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS \"O\", round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS \"P\" FROM orders GROUP BY 1")
def pivot_metrics(spark, d):
    return rounded(t(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")), 2)


@query(f"""WITH {TICKS}, s AS (SELECT ticker, (n - 1) // 50 AS segment, min(ts) AS a, max(ts) AS b FROM (SELECT ticker, ts,
  row_number() OVER (PARTITION BY ticker ORDER BY ts, tick_id) AS n FROM ticks) GROUP BY 1, 2)
  SELECT CAST(s.ticker AS VARCHAR) AS ticker, CAST(segment AS BIGINT) AS segment, count(*) AS tokens, round(sum(value),
  2) AS total FROM s JOIN events e ON e.event_type = CASE s.ticker WHEN 'view' THEN 'click' WHEN 'click' THEN 'view'
  ELSE s.ticker END AND e.ts BETWEEN a AND b GROUP BY 1, 2""")
def interval_segment_tokens(spark, d):
    """Ticks of one series in the segments of another."""
    x = ticks(spark, d).withColumn("day", F.to_date("ts"))
    s = O.cut(x, ["ticker"], "day", ["ts", "tick_id"], 50, "segment").groupBy("ticker", "segment").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    kind = F.col("event_type")
    tokens = t(spark, d, "events").select(F.when(kind == "view", "click").when(kind == "click", "view").otherwise(kind).alias("ticker"), "ts", "value")
    return rounded(A.within(tokens, s, ["ticker"], "ts").groupBy("ticker", "segment").agg(F.count("*").alias("tokens"), F.sum("value").alias("total")), 2)


@query("""SELECT kind, id, CAST(ts AS VARCHAR) AS ts, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, kind, id) AS INTEGER) AS nth FROM (
  SELECT 0 AS kind, event_id AS id, ts FROM events UNION ALL SELECT 1 AS kind, o_orderkey AS id, o_orderdate AS ts FROM orders)""")
def merge_streams(spark, d):
    a = t(spark, d, "events").select(F.lit(0).alias("kind"), F.col("event_id").alias("id"), "ts")
    b = t(spark, d, "orders").select(F.lit(1).alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    u = a.unionByName(b)
    return u.select("kind", "id", F.col("ts").cast("string").alias("ts"), F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "kind", "id")).alias("nth"))


@query("""WITH a AS (SELECT l_returnflag AS flag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem), b AS (SELECT o_orderstatus AS s, o_totalprice, row_number()
  OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS nth FROM orders)
  SELECT flag, l_orderkey, l_linenumber, a.nth, round(coalesce(o_totalprice, 0), 2) AS price FROM a LEFT JOIN b ON
  a.nth = b.nth AND b.s = CASE flag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END""")
def positional_join(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber")
    s = F.col("o_orderstatus")
    b = t(spark, d, "orders").select(F.when(s == "F", "A").when(s == "O", "N").otherwise("R").alias("flag"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return rounded(A.by_position(a, b, ["flag"], ["l_orderkey", "l_linenumber"], ["o_orderkey"], ["price"], (F.floor(F.col("l_orderkey") / 4096), F.floor(F.col("o_orderkey") / 4096))), 2)


# --- events, vectors, metrics, manifests ------------------------------------------------------------------------------

SHOWN = "CASE p_partkey % 8 WHEN 0 THEN p_size || '%' WHEN 1 THEN p_size || 'K' WHEN 2 THEN '-' || p_retailprice || 'M' WHEN 3 THEN p_retailprice || '|' || p_size WHEN 4 THEN ' ' || p_size || ' ' WHEN 5 THEN '' WHEN 6 THEN p_size || 'b' ELSE p_name END"


@query(f"""WITH y AS (SELECT p_partkey, trim(split_part({SHOWN}, '|', 1)) AS f FROM part) SELECT p_partkey, round(TRY_CAST(regexp_replace(f,
  '[%KkMmBbTt]$', '') AS DOUBLE) * CASE upper(right(f, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9
  WHEN 'T' THEN 1e12 ELSE 1 END, 4) AS value FROM y""")
def parse_value(spark, d):
    return rounded(t(spark, d, "part").select("p_partkey", S.parse_value(F.expr(SHOWN)).alias("value")))


@query("""WITH long AS (SELECT p_brand AS b, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_brand, p_retailprice
  / 100 FROM part), s AS (SELECT b, CASE WHEN count(x) < 3 THEN 0 ELSE avg(x) END AS m, CASE WHEN count(x) < 3
  OR stddev_samp(x) < 1e-10 THEN 1 ELSE stddev_samp(x) END AS s FROM long GROUP BY 1)
  SELECT p_partkey, round((p_size - m) / s, 4) AS size_z, round((p_retailprice / 100 - m) / s, 4) AS price_z FROM part JOIN s ON b = p_brand""")
def event_zscore(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    x = p.select("p_brand", F.explode(F.array("a", "b")).alias("x")).groupBy("p_brand").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    x = x.select("p_brand", F.when(F.col("n") < 3, 0.0).otherwise(F.col("m")).alias("m"), F.when((F.col("n") < 3) | (F.col("s") < 1e-10), 1.0).otherwise(F.col("s")).alias("s"))
    return rounded(p.join(x, "p_brand").select("p_partkey", ((F.col("a") - F.col("m")) / F.col("s")).alias("size_z"), ((F.col("b") - F.col("m")) / F.col("s")).alias("price_z")))


@query("""WITH x AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n FROM
  events), m AS (SELECT max(n) AS m FROM x) SELECT event_id, round(CAST(n AS DOUBLE) / greatest(m, 1), 6) AS rank_norm
  FROM x, m""")
def event_rank_day(spark, d):
    x = t(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")) - 1).alias("n"))
    most = x.agg(F.greatest(F.max("n"), F.lit(1)).alias("m"))  # one row
    return rounded(x.join(F.broadcast(most)).select("event_id", (F.col("n") / F.col("m")).alias("rank_norm")), 6)


@query("""SELECT o_orderkey, round(coalesce(least(CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER (PARTITION
  BY o_custkey ORDER BY o_orderdate, o_orderkey), 90), 90) / 90.0, 6) AS since FROM orders""")
def days_since_same(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return rounded(t(spark, d, "orders").select("o_orderkey", (F.coalesce(F.least(F.datediff("o_orderdate", F.lag("o_orderdate").over(w)), F.lit(90)), F.lit(90)) / 90.0).alias("since")), 6)


@query("""WITH v AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)) SELECT
  p_partkey, CAST(id AS INTEGER) AS type_id FROM part JOIN v USING (p_type)""")
def vocab_ids(spark, d):
    p = t(spark, d, "part")
    ids = p.select("p_type").distinct().withColumn("type_id", F.row_number().over(Window.orderBy("p_type")))  # a vocabulary: one row a type
    return p.join(ids, "p_type").select("p_partkey", "type_id")


@query("""WITH x AS (SELECT label, exp(-(vec_id % 7) / 7.0) AS w, unnest(embedding) AS v, generate_subscripts(embedding,
  1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(w * CAST(v AS DOUBLE)) /
  sum(w), 6) + 0 AS pooled FROM x GROUP BY 1, 2""")
def embedding_softmax_pool(spark, d):
    e = t(spark, d, "embeddings").select("label", "embedding", (-(F.col("vec_id") % 7) / 7.0).alias("score"))
    return Q.softmax_pool(e, ["label"], "embedding", "score").select("label", "pos", (F.round("pooled", 6) + 0.0).alias("pooled"))


@query("""SELECT vec_id, len(embedding) + 3 AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))),
  6) + 0 AS total, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most FROM embeddings""")
def embedding_concat_stats(spark, d):
    e = F.col("embedding").cast("array<double>")
    joined = F.concat(e, F.array(F.array_max(e), F.array_min(e), F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))
    x = t(spark, d, "embeddings").select("vec_id", joined.alias("v"))
    return x.select("vec_id", F.size("v").cast("long").alias("width"), (F.round(F.element_at("v", -1), 6) + 0.0).alias("total"), F.round(F.element_at("v", -3), 6).alias("most"))


HUBER = "(CASE WHEN abs(e) <= 0.25 THEN 0.5 * e * e ELSE 0.25 * (abs(e) - 0.125) END)"
PRED = "p AS (SELECT l_linenumber AS horizon, l_orderkey % 32 AS batch, l_quantity / 10 - 2.5 AS target, l_extendedprice / 20000 - 2.5 AS pred, l_discount > 0.01 AS mask FROM lineitem)"


def _predictions(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_linenumber").alias("horizon"), (F.col("l_orderkey") % 32).alias("batch"), (F.col("l_quantity") / 10 - 2.5).alias("target"), (F.col("l_extendedprice") / 20000 - 2.5).alias("pred"), (F.col("l_discount") > 0.01).alias("mask"))


@query(f"""WITH {PRED}, q AS (SELECT *, pred - target AS e, CASE WHEN abs(target) >= 4 THEN 5 WHEN abs(target) >= 2 THEN 3
  ELSE 1 END AS w FROM p WHERE mask), b AS (SELECT horizon, batch, sum(w * {HUBER}) / greatest(count(*), 1) AS
  loss FROM q GROUP BY 1, 2) SELECT horizon, round(avg(loss), 4) AS loss, count(*) AS batches FROM b GROUP BY 1""")
def huber_spike_loss(spark, d):
    p = _predictions(spark, d).where("mask")
    b = p.groupBy("horizon", "batch").agg((F.sum(S.spike_weight(F.col("target")) * S.huber(F.col("pred") - F.col("target"))) / F.greatest(F.count("*"), F.lit(1))).alias("loss"))
    return rounded(b.groupBy("horizon").agg(F.avg("loss").alias("loss"), F.count("*").alias("batches")))


METRICS = "avg(abs(pred - target)) AS mae, 100.0 * avg(CASE WHEN (pred > 0) = (target > 0) THEN 1 ELSE 0 END) AS direction, 100.0 * avg(CASE WHEN abs(pred - target) < 1 THEN 1 ELSE 0 END) AS within1, 100.0 * avg(CASE WHEN abs(pred - target) < 2 THEN 1 ELSE 0 END) AS within2"


def _metrics(p: DataFrame, *keys: str) -> DataFrame:
    e, share = F.abs(F.col("pred") - F.col("target")), lambda c: F.avg(c.cast("double")) * 100
    return p.groupBy(*keys).agg(F.avg(e).alias("mae"), share((F.col("pred") > 0) == (F.col("target") > 0)).alias("direction"), share(e < 1).alias("within1"), share(e < 2).alias("within2"))


@query(f"""WITH {PRED}, m AS (SELECT horizon, {METRICS} FROM p WHERE mask GROUP BY 1) SELECT horizon, round(mae, 4) AS mae,
  round(direction, 4) AS direction, round(within1, 4) AS within1, round(within2, 4) AS within2 FROM m""")
def horizon_metrics(spark, d):
    return rounded(_metrics(_predictions(spark, d).where("mask"), "horizon"))


@query(f"""WITH {PRED}, c AS (SELECT 'all' AS condition, pred, target FROM p WHERE mask UNION ALL SELECT 'no_scale', pred
  / 2, target FROM p WHERE mask UNION ALL SELECT 'null', 0, target FROM p WHERE mask), m AS (SELECT condition,
  avg(abs(pred - target)) AS mae FROM c GROUP BY 1), b AS (SELECT mae AS base FROM m WHERE condition = 'all') SELECT
  condition, round(mae, 4) AS mae, round(mae - base, 4) AS delta, CAST(row_number() OVER (ORDER BY mae - base DESC,
  condition) AS INTEGER) AS rank FROM m, b""")
def ablation_delta(spark, d):
    p = _predictions(spark, d).where("mask")
    conditions = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), v.alias("pred")) for n, v in (("all", F.col("pred")), ("no_scale", F.col("pred") / 2), ("null", F.lit(0.0)))]))
    m = _metrics(p.select("target", conditions.alias("c")).select("target", "c.*"), "condition").select("condition", "mae")
    m = m.join(F.broadcast(m.where("condition = 'all'").select(F.col("mae").alias("base")))).withColumn("delta", F.col("mae") - F.col("base"))
    return m.select("condition", F.round("mae", 4).alias("mae"), F.round("delta", 4).alias("delta"), F.row_number().over(Window.orderBy(F.desc("delta"), "condition")).alias("rank"))


@query("""WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate
  AS DATE) AS day FROM lineitem) SELECT CAST(day AS VARCHAR) AS day, side FROM (SELECT day, 'missing' AS side FROM
  (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT day, 'extra' FROM (SELECT * FROM b EXCEPT SELECT *
  FROM a))""")
def date_coverage_diff(spark, d):
    a, b = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return rounded(Q.missing(a, b, "day"))


@query("""SELECT o_orderkey AS key, round(o_totalprice, 2) AS size, 'old' AS source FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, round(o_totalprice * 2, 2), 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def manifest_upsert(spark, d):
    o = t(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("size"), F.lit("old").alias("source"))
    new = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 2, 2).alias("size"), F.lit("new").alias("source"))
    return Q.upsert(old, new, "key")


@query("""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'data/' || year(o_orderdate) || '/x.parquet' WHEN
  1 THEN 'data/' || strftime(o_orderdate, '%Y-%m-%d') || '.parquet' WHEN 2 THEN year(o_orderdate) || '_embedded.parquet'
  ELSE 'data/readme.txt' END AS path, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
  SELECT o_orderkey, path, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE y END AS year FROM p WHERE o_orderkey % 4 = 3 OR y BETWEEN 1996 AND 1998""")
def year_filter(spark, d):
    k, date = F.col("o_orderkey") % 4, F.col("o_orderdate")
    path = F.when(k == 0, F.concat(F.lit("data/"), F.year(date), F.lit("/x.parquet"))).when(k == 1, F.concat(F.lit("data/"), F.date_format(date, "yyyy-MM-dd"), F.lit(".parquet"))).when(k == 2, F.concat(F.year(date), F.lit("_embedded.parquet"))).otherwise(F.lit("data/readme.txt"))
    p = t(spark, d, "orders").select("o_orderkey", path.alias("path")).withColumn("year", S.path_year(F.col("path")))
    return p.where(F.coalesce(F.col("year").between(1996, 1998), F.lit(True)))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate <= DATE '1998-12-31' THEN 'train' WHEN o_orderdate <= DATE '1999-12-31'
  THEN 'val' ELSE 'test' END AS split FROM orders""")
def split_label(spark, d):
    day = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.when(day <= F.lit("1998-12-31").cast("date"), "train").when(day <= F.lit("1999-12-31").cast("date"), "val").otherwise("test").alias("split"))


@query("""SELECT event_type AS ticker, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC,
  event_id DESC) AS n FROM events) WHERE n <= 25""")
def tail_k_per_key(spark, d):
    return Q.keep_k(t(spark, d, "events").select(F.col("event_type").alias("ticker"), "event_id", "ts"), ["ticker"], [F.desc("ts"), F.desc("event_id")], 25).select("ticker", "event_id")


@query("""SELECT CAST(day AS VARCHAR) AS day, event_id FROM (SELECT CAST(ts AS DATE) AS day, event_id, row_number() OVER
  (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_type, event_id) AS n FROM events) WHERE n <= 195""")
def head_k_per_day(spark, d):
    e = t(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", "ts", "event_type")
    return rounded(Q.keep_k(e, ["day"], ["ts", "event_type", "event_id"], 195).select("day", "event_id"))


@query(f"""WITH {DAILY} SELECT flag, CAST(day AS VARCHAR) AS day, round(0.5 * v + 0.3 * coalesce(lag(v, 1) {BY_DAY}, 0) +
  0.2 * coalesce(lag(v, 2) {BY_DAY}, 0), 5) AS conv FROM daily""")
def causal_conv(spark, d):
    x, w = _days(spark, d)
    return rounded(x.select("flag", "day", Q.causal_conv("v", [0.5, 0.3, 0.2], w).alias("conv")), 5)


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS k, c_acctbal / 1000 AS x, 0.1 + (c_custkey % 5) / 10.0 AS dt, 1.0 + c_custkey
  % 2 AS b0, 0.5 AS b1, (c_custkey % 3) / 2.0 AS c0, 1.0 AS c1, c_nationkey AS g, row_number() OVER (PARTITION
  BY c_nationkey ORDER BY c_custkey) AS n FROM customer), s AS (
  SELECT g, n, k, dt * b0 * x AS h0, dt * b1 * x AS h1, x, c0, c1 FROM r WHERE n = 1 UNION ALL SELECT r.g, r.n, r.k,
  exp(-r.dt) * s.h0 + r.dt * r.b0 * r.x, exp(-2 * r.dt) * s.h1 + r.dt * r.b1 * r.x, r.x, r.c0, r.c1 FROM s JOIN
  r ON r.g = s.g AND r.n = s.n + 1)
  SELECT g AS nation, k AS c_custkey, round(c0 * h0 + c1 * h1 + 0.25 * x, 4) AS y FROM s""")
def selective_scan(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (0.1 + (k % 5) / 10.0).alias("dt"), F.floor(k / 4096).alias("cell"))
    c = c.withColumns({"b": F.array((1.0 + k % 2).cast("double"), F.lit(0.5)), "c": F.array((k % 3) / 2.0, F.lit(1.0))})
    return rounded(Q.selective_scan(c, ["nation"], "cell", ["c_custkey"], "x", "dt", [-1.0, -2.0], "b", "c", 0.25, "y").select("nation", "c_custkey", "y"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1), b AS (SELECT
  CAST(l_shipdate AS DATE) AS day, avg(l_tax) AS rate FROM lineitem WHERE l_linenumber = 6 GROUP BY 1), m AS (SELECT
  coalesce(a.day, b.day) AS day, price, rate FROM a FULL JOIN b ON a.day = b.day), f AS (
  SELECT day, last_value(price IGNORE NULLS) OVER w AS price, last_value(rate IGNORE NULLS) OVER w AS rate FROM m
  WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)) SELECT CAST(day AS VARCHAR) AS day, round(lag(price) OVER
  (ORDER BY day), 6) AS price, round(lag(rate) OVER (ORDER BY day), 8) AS rate FROM f""")
def macro_outer_join(spark, d):
    a = t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    b = t(spark, d, "lineitem").where("l_linenumber = 6").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_tax").alias("rate"))
    w = Window.orderBy("day")  # a row a calendar day
    m = a.join(b, "day", "full").withColumns({c: R.ffill(F.col(c), w) for c in ("price", "rate")})
    m = R.shift_all(m, ["price", "rate"], w)
    return m.select(F.col("day").cast("string").alias("day"), F.round("price", 6).alias("price"), F.round("rate", 8).alias("rate"))


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def time_unit_detection(spark, d):
    e = t(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    k = F.col("event_id") % 4
    number = F.when(k == 0, F.col("us") * 1000).when(k == 1, F.col("us")).when(k == 2, F.floor(F.col("us") / 1000)).otherwise(F.floor(F.col("us") / 1000000))
    return e.select("event_id", S.epoch_seconds(number.cast("long")).alias("seconds"))


@query("""SELECT p_brand, median(p_retailprice) AS median, count(DISTINCT p_type) AS types, max(n) AS most FROM (SELECT *,
  count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) GROUP BY 1""")
def median_distinct(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_size", "p_type", "p_retailprice")
    most = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.max("n").alias("most"))
    types = p.groupBy("p_brand", "p_type").agg(F.lit(1).alias("one")).groupBy("p_brand").agg(F.count("*").alias("types"))
    middle = N.exact_quantiles(p, ["p_brand"], "p_retailprice", {"median": 0.5})
    return O.matched(O.matched(middle, types, ["p_brand"]), most, ["p_brand"]).select("p_brand", "median", "types", "most")


# --- candidate scores, runs, sources and sinks ------------------------------------------------------------------------


@query("""WITH a AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS s FROM embeddings), b AS (SELECT label, vec_id,
  (CASE WHEN vec_id % 7 = 0 THEN CASE WHEN s < 0 THEN s * 1.2 ELSE s / 1.2 END ELSE s END) / 0.8 AS logit FROM
  a),
  c AS (SELECT *, CASE WHEN rank() OVER (PARTITION BY label ORDER BY logit DESC) <= 40 THEN exp(logit - max(logit)
  OVER (PARTITION BY label)) END AS mass FROM b),
  e AS (SELECT *, sum(mass) OVER (PARTITION BY label ORDER BY logit, vec_id ROWS UNBOUNDED PRECEDING) / sum(mass)
  OVER (PARTITION BY label) AS below FROM c), f AS (SELECT *, coalesce(mass IS NOT NULL AND below > 0.1 AND mass
  >= 0.05, false) AS kept FROM e)
  SELECT label, vec_id, round(logit, 4) + 0 AS logit, kept, round(coalesce(CASE WHEN kept THEN mass / sum(CASE WHEN
  kept THEN mass END) OVER (PARTITION BY label) END, 0), 4) AS prob FROM f""")
def score_filters(spark, d):
    e = t(spark, d, "embeddings").select("label", "vec_id", (F.col("embedding")[0].cast("double") * 4).alias("score"), (F.col("vec_id") % 7 == 0).alias("seen"))
    x = C.filter_scores(e, ["label"], "vec_id", "score", seen="seen", penalty=1.2, temperature=0.8, top_k=40, top_p=0.9, min_p=0.05)
    return rounded(x.select("label", "vec_id", "logit", "kept", "prob"))


@query("""WITH l AS (SELECT o_orderstatus AS run, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
  avg(o_totalprice) AS loss FROM orders GROUP BY 1, 2),
  a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n, min(loss) OVER (PARTITION BY run ORDER
  BY epoch ROWS UNBOUNDED PRECEDING) AS best, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS
  BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM l),
  b AS (SELECT *, n - max(CASE WHEN better THEN n END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)
  AS since FROM a) SELECT run, epoch, round(best, 2) AS best, since, bool_or(since >= 5) OVER (PARTITION BY run
  ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM b""")
def early_stop(spark, d):
    day = F.col("o_orderdate")
    x = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("run"), (F.year(day) * 12 + F.month(day)).alias("epoch")).agg(F.avg("o_totalprice").alias("loss"))
    return rounded(C.early_stop(x, ["run"], "epoch", "loss", 5).drop("loss"), 2)


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CAST(day AS VARCHAR) AS day, day
  IN (SELECT CAST(ts AS DATE) FROM events) AS ticks, day IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE
  l_linenumber = 7) AS filings FROM d""")
def stream_availability(spark, d):
    days = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    streams = {"ticks": t(spark, d, "events").select(F.to_date("ts").alias("day")), "filings": t(spark, d, "lineitem").where("l_linenumber = 7").select(F.to_date("l_shipdate").alias("day"))}
    return rounded(C.availability(days, streams, "day"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, list(s) OVER w AS each, s FROM (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity
  AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS s, l_quantity
  FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING))
  SELECT l_orderkey, l_linenumber, array_to_string(list_transform(each, lambda v: CAST(s - v AS BIGINT)), ',') AS sums FROM x""")
def segment_sums(spark, d):
    """Null lines and quantities come last, the order is by the quantity itself, its sums by whole numbers, halves to even. Sums known nowhere are null."""
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.rint("l_quantity").cast("bigint").alias("q"))
    sums = Q.segment_sums(x, ["l_orderkey"], [F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("l_quantity")], "q", "sums")
    return sums.select("l_orderkey", "l_linenumber", F.when(F.exists("sums", F.isnotnull), F.array_join("sums", ",")).alias("sums"))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS length FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR)
  AS day, length, CAST(sum(length) OVER (ORDER BY day) - length AS BIGINT) AS "offset" FROM c""")
def day_index(spark, d):
    return rounded(sinks.day_index(t(spark, d, "events").select(F.to_date("ts").alias("day")), "day"))


KEYS = "keys AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'logs/' ELSE 'training/' END || strftime(o_orderdate, '%Y%m') || '/ckpt_' || o_orderkey AS key, CAST(o_orderkey % 1000 AS BIGINT) AS size FROM orders)"


def _keys(spark, d):
    k = F.col("o_orderkey")
    key = F.concat(F.when(k % 4 == 0, "logs/").otherwise("training/"), F.date_format("o_orderdate", "yyyyMM"), F.lit("/ckpt_"), k)
    return t(spark, d, "orders").select("o_orderkey", key.alias("key"), (k % 1000).cast("bigint").alias("size"))


@query(f"WITH {KEYS} SELECT DISTINCT split_part(key, '/', 2) AS run_id FROM keys WHERE key LIKE 'training/%'")
def run_ids(spark, d):
    return files.run_ids(_keys(spark, d), "training/")


@query(f"WITH {KEYS} SELECT key, size FROM keys WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def transfer_diff(spark, d):
    local = _keys(spark, d)
    stored = local.where("o_orderkey % 3 != 0").withColumn("size", F.when(F.col("o_orderkey") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return files.to_send(local.select("key", "size"), stored)


@query("""WITH r AS (SELECT o_custkey AS cik, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS u, o_totalprice AS value,
  CAST(o_orderdate AS DATE) AS filed FROM orders)
  SELECT cik, 'revenue' AS metric, CASE u WHEN 1 THEN 'USD' ELSE 'shares' END AS unit, round(value, 2) AS value,
  CAST(filed AS VARCHAR) AS filed FROM (SELECT *, min(u) OVER (PARTITION BY cik) AS least FROM r) WHERE u = least""")
def company_facts(spark, d):
    """Orders as company documents in JSON, read back: the first unit of a tag counts."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("cik"), F.when(F.col("o_orderstatus") == "F", "USD").otherwise("shares").alias("unit"), F.struct(F.col("o_totalprice").alias("val"), F.to_date("o_orderdate").cast("string").alias("filed")).alias("fact"))
    units = o.groupBy("cik", "unit").agg(F.collect_list("fact").alias("all")).groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("unit", "all"))).alias("units"))
    docs = units.select(F.to_json(F.struct("cik", F.struct(F.create_map(F.lit("Revenues"), F.struct("units")).alias("us-gaap")).alias("facts"))).alias("value"))
    return rounded(documents.facts(docs, {"revenue": ["Revenues", "SalesRevenueNet"]}).select("cik", "metric", "unit", "value", "filed"), 2)


@query(f"""WITH {TICKS} SELECT ticker, tick_id, round(CASE WHEN count(price) {TICK_CUM} < 2 THEN 0 ELSE (price - avg(price)
  {TICK_CUM}) / sqrt(greatest(avg(price * price) {TICK_CUM} - avg(price) {TICK_CUM} * avg(price) {TICK_CUM}, 1e-8))
  END, 4) + 0 AS z FROM ticks""")
def stream_cumulative_zscore(spark, d):
    """The running z-score of a stream of ticks, whose state is three numbers a ticker."""
    x = _tick_stream(spark, d).select("ticker", "ts", "tick_id", "price")
    return rounded(drained(running.stream_cumulative_zscore(x, "ticker", ["ts", "tick_id"], "price")).select("ticker", "tick_id", "z"))


@query(f"""WITH {BARS} SELECT ticker, CAST(bar AS VARCHAR) AS bar, round(open, 4) AS open, round(high, 4) AS high, round(low,
  4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, trade_count FROM agg""")
def stream_bars(spark, d):
    """Bars from a stream of ticks, with those still open when the source is read to its end."""
    return rounded(drained(streams.stream_bars(_tick_stream(spark, d), "6 hours", "1 hour"), "update", ["ticker", "bar"], "trade_count"))


def _tick_stream(spark: SparkSession, d: str) -> DataFrame:
    # A stream takes no path to one file, but a pattern that fits one file or one folder.
    e = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    volume = F.coalesce(F.from_json("props", "k bigint").k.cast("double"), F.lit(0.0))
    return e.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"), volume.alias("volume"))
