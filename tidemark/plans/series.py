"""Queries over series too long for one task, exact quantiles of large groups, streams with state, stores and transfers.

Raw ticks stand for long series. Cells are six hours; blocks are kept short, so that the tables of the tests have several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import long_series as L
from ..operators import macro
from ..operators import pooling, quantiles
from ..operators import rolling as R
from ..sources import files, store
from ..sources import series as macro_series
from ..sources.sinks import kept
from ..streaming import ordered
from ..streaming.sinks import drained, shared_folder
from .catalogue import BARS, DAILY, TICKS, _cum, _full, query_of, rounded, t, ticks
from .features import CHAIN, HORIZONS, MACRO_SQL, RV_COLUMNS, _macro

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_of(QUERIES, SQL)

#: Rows of a block in these queries; the operators' own default is several thousand.
ROWS = 512


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Ticks with the number of the six hours that they lie in."""
    return ticks(spark, d).withColumn("cell", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000))


def along(spark: SparkSession, d: str, before: int, build) -> DataFrame:
    """build over the ticks of each ticker in order, with what it sees of the `before` rows ahead of a block."""
    return L.in_blocks(cells(spark, d), ["ticker"], "cell", ["ts", "tick_id"], before, build, rows=ROWS)


# --- frames over raw ticks --------------------------------------------------------------------------------------------

BY = "PARTITION BY ticker ORDER BY ts, tick_id"
RETURNS = f"{TICKS}, r AS (SELECT *, CASE WHEN price > 0 AND lag(price) OVER ({BY}) > 0 THEN ln(price / lag(price) OVER ({BY})) END AS ret FROM ticks)"


@query(f"WITH {RETURNS} SELECT ticker, tick_id, " + ", ".join(f"round(sqrt({_full('sum(ret * ret) $', 'ret', k, BY)}), 7) AS rv{k}, round(sqrt({_full('sum(ret * ret) $', 'ret', k, BY, max(1, k // 2))}), 7) AS part_rv{k}" for k in (30, 120)) + " FROM r")
def rolling_rv_ticks(spark, d):
    """Realised volatility over the last 30 and 120 ticks, whole and from half a window on."""
    def build(x, w):
        x, r = x.withColumn("ret", R.log_return(F.col("price"), w)), F.col("ret")
        return x.withColumns({k: v for n in (30, 120) for k, v in ((f"rv{n}", R.rolling_rv(r, n, w)), (f"part_rv{n}", R.rolling_rv(r, n, w, max(1, n // 2))))})

    return rounded(along(spark, d, 121, build).select("ticker", "tick_id", "rv30", "part_rv30", "rv120", "part_rv120"), 7)


TICK_CHAIN = f"{TICKS}, daily AS (SELECT ticker AS flag, row_number() OVER ({BY}) AS day, price AS v FROM ticks)" + CHAIN.removeprefix(DAILY).replace("ln(v / lag(v)", "ln(CASE WHEN v > 0 THEN v END / lag(CASE WHEN v > 0 THEN v END)")


@query(f"WITH {TICK_CHAIN} SELECT flag AS ticker, day AS nth, " + ", ".join(f"round(coalesce(CASE WHEN {'rv_zscore_1h' if c == 'rv_rank_2h' else c} IS NOT NULL THEN {c} END, 0), 7) + 0 AS {c}" for c in RV_COLUMNS) + " FROM e")
def rv_chain_ticks(spark, d):
    """The volatility chain over raw ticks: windows over windows reach back 61 rows, or 1 + 15 + 30."""
    def build(x, w):
        return R.rv_chain(x.withColumn("ret", R.log_return(F.col("price"), w)), "ret", w, HORIZONS).withColumn("nth", F.col("_i"))

    return rounded(along(spark, d, 64, build).select("ticker", "nth", *RV_COLUMNS), 7)


@query(f"""WITH {TICKS}, x AS (SELECT *, {_full('avg(price) $', 'price', 60, BY)} AS m, {_full('stddev_pop(price) $', 'price', 60, BY)}
  AS s, {_full('quantile_cont(price, 0.9) $', 'price', 60, BY)} AS p90, {_full('avg(volume) $', 'volume', 150, BY, 50)} AS sma150
  FROM ticks)
  SELECT ticker, tick_id, round(sma150, 7) AS sma150, round(CASE WHEN s > 1e-8 THEN (price - m) / s END, 7) + 0 AS z60, round(p90,
  7) AS p90,
  CASE WHEN p90 IS NOT NULL THEN price > p90 END AS stressed FROM x""")
def rolling_frames_ticks(spark, d):
    """Means, z-scores and a stress flag by the rolling 90th percentile."""
    def build(x, w):
        p, v = F.col("price"), F.col("volume")
        x = x.withColumns({"sma150": R.rolling(F.avg(v), v, 150, w, 50), "z60": R.rolling_zscore(p, 60, w), "p90": R.rolling(F.percentile(p, 0.9), p, 60, w)})
        return x.withColumn("stressed", p > F.col("p90"))

    return rounded(along(spark, d, 149, build).select("ticker", "tick_id", "sma150", "z60", "p90", "stressed"), 7)


@query(f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (ORDER BY ts, tick_id) AS i FROM ticks) SELECT a.tick_id, CASE WHEN a.i >= 3000
  THEN round(count(CASE WHEN b.price <= a.price THEN 1 END) / 3000.0, 7) END AS pct FROM n a JOIN n b ON b.i BETWEEN a.i - 2999 AND a.i
  GROUP BY a.tick_id, a.i""")
def percentile_of_3000(spark, d):
    """Of all ticks as one series: the share of the last 3,000 prices that are no higher."""
    x = cells(spark, d).withColumn("all", F.lit(0))
    return rounded(L.percentile_rank(x, ["all"], "cell", ["ts", "tick_id"], "price", 3000, "pct", rows=3000).select("tick_id", "pct"), 7)


# --- running values ---------------------------------------------------------------------------------------------------

CUM = f"OVER ({BY} ROWS UNBOUNDED PRECEDING)"


def cum(x: str) -> str:
    return f"(CASE WHEN count({x}) {CUM} < 2 THEN 0 ELSE ({x} - avg({x}) {CUM}) / sqrt(greatest(avg({x} * {x}) {CUM} - avg({x}) {CUM} * avg({x}) {CUM}, 1e-8)) END)"


@query(f"WITH {TICKS} SELECT ticker, tick_id, round({cum('price')}, 5) + 0 AS price_z, round({cum('volume')}, 5) + 0 AS volume_z FROM ticks")
def cumulative_zscore_ticks(spark, d):
    """Each tick against all before it: counts, sums and sums of squares of cells are put together first."""
    z = L.cumulative_zscore(cells(spark, d), ["ticker"], "cell", ["ts", "tick_id"], {"price": "price_z", "volume": "volume_z"})
    return rounded(z.select("ticker", "tick_id", "price_z", "volume_z"), 5)


@query(f"""WITH {BARS.replace('6 hours', '10 minutes')}, x AS (SELECT *, CAST(trade_count AS DOUBLE) AS tc FROM agg) SELECT ticker,
  CAST(bar AS VARCHAR) AS
  bar, round({_cum('price_std')} + {_cum('volume')} - {_cum('tc')}, 5) + 0 AS liquidity_stress FROM x""")
def liquidity_stress_bars(spark, d):
    """The stress of ten-minute bars, days as cells."""
    b = B.bars(ticks(spark, d), "10 minutes").withColumn("day", F.to_date("bar"))
    z = L.cumulative_zscore(b, ["ticker"], "day", ["bar"], {"price_std": "zs", "volume": "zv", "trade_count": "zn"})
    return rounded(z.select("ticker", "bar", (F.col("zs") + F.col("zv") - F.col("zn")).alias("liquidity_stress")), 5)


STATES = 16


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, value AS x, 0.05 + (event_id % 7) / 40.0 AS dt, list_transform(range(1,
  {STATES + 1}), lambda n: ((event_id + n) % 5) / 4.0) AS b,
  list_transform(range(1, {STATES + 1}), lambda n: ((event_id * n) % 3) / 2.0) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts,
  event_id) AS i FROM events),
  s AS (SELECT user_id, i, event_id, x, c, list_transform(range(1, {STATES + 1}), lambda n: dt * b[n] * x) AS h FROM r WHERE i = 1 UNION ALL
  SELECT r.user_id, r.i, r.event_id, r.x, r.c, list_transform(range(1, {STATES + 1}),
  lambda n: exp(-r.dt * n / 4) * s.h[n] + r.dt * r.b[n] * r.x) FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
  SELECT user_id, event_id, round(list_sum(list_transform(range(1, {STATES + 1}), lambda n: c[n] * h[n])) + 0.25 * x, 9) + 0 AS y FROM s""")
def selective_scan_states(spark, d):
    """The scan with sixteen states at once, along each user's events."""
    id_, all_ = F.col("event_id"), F.sequence(F.lit(1), F.lit(STATES))
    e = t(spark, d, "events").select("user_id", "event_id", "ts", F.col("value").alias("x"), (0.05 + (id_ % 7) / 40.0).alias("dt"))
    e = e.withColumns({"b": F.transform(all_, lambda n: ((id_ + n) % 5) / 4.0), "c": F.transform(all_, lambda n: ((id_ * n) % 3) / 2.0), "cell": F.floor(F.unix_date(F.to_date("ts")) / 16)})
    y = L.scan(e, ["user_id"], "cell", ["ts", "event_id"], "x", "dt", [-n / 4 for n in range(1, STATES + 1)], "b", "c", 0.25, "y")
    return rounded(y.select("user_id", "event_id", "y"), 9)


# --- exact quantiles --------------------------------------------------------------------------------------------------


@query("""SELECT event_type AS ticker, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.999), 6) AS q999 FROM events GROUP BY 1""")
def tail_quantiles(spark, d):
    """Quantiles of all ticks by counts below candidates, no more than 100 values in one buffer."""
    return rounded(quantiles.exact_quantiles(ticks(spark, d), ["ticker"], "price", {"q01": 0.01, "q50": 0.5, "q999": 0.999}, few=100), 6)


# --- buckets of vectors -----------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, CAST(vec_id % 50 AS BIGINT) AS bucket, embedding, (vec_id % 29 - 14) * 50.0 AS tone, label
  FROM embeddings),
  m AS (SELECT bucket, min(tone) AS low FROM e GROUP BY 1), w AS (SELECT e.bucket, exp(low - tone) AS w, unnest(embedding) AS v,
  generate_subscripts(embedding, 1) AS pos FROM e JOIN m USING (bucket)),
  p AS (SELECT bucket, pos, sum(w * v) / sum(w) AS v FROM w GROUP BY 1, 2),
  s AS (SELECT bucket, count(*) AS n, min(tone) AS min_tone, avg(tone) AS mean_tone, max(label) AS most, avg(CASE WHEN label IN (7, 8,
  9) THEN 1.0 ELSE 0 END) AS conflict_ratio FROM e GROUP BY 1)
  SELECT b.bucket, coalesce(n, 0) AS n, coalesce(round(min_tone, 4), 0) + 0 AS min_tone, coalesce(round(mean_tone, 7),
  0) + 0 AS mean_tone, coalesce(CAST(most AS INTEGER), 0) AS most, coalesce(round(conflict_ratio, 7), 0) AS conflict_ratio,
  coalesce(round(any_value(p.v) FILTER (WHERE pos = 1), 7), 0) + 0 AS first, coalesce(round(sum(p.v), 5), 0) + 0 AS total
  FROM (SELECT CAST(range AS BIGINT) AS bucket FROM range(60)) b LEFT JOIN s USING (bucket) LEFT JOIN p USING (bucket) GROUP BY ALL""")
def bucket_embeddings(spark, d):
    """Article vectors pooled by softmax of the negative tone, up to 700 either way, with statistics; ten of the buckets are empty."""
    id_ = F.col("vec_id")
    e = t(spark, d, "embeddings").select((id_ % 50).alias("bucket"), "embedding", ((id_ % 29 - 14) * 50.0).alias("tone"), "label")
    tone = F.col("tone")
    facts = {"min_tone": F.min(tone), "mean_tone": F.avg(tone), "most": F.max("label"), "conflict_ratio": F.avg(F.when(F.col("label").isin(7, 8, 9), 1.0).otherwise(0.0))}
    x = pooling.pooled_buckets(e.withColumn("score", -tone), spark.range(60).toDF("bucket"), ["bucket"], "embedding", "score", facts, 64)
    total = F.aggregate("pooled", F.lit(0.0), lambda a, v: a + v)
    shown = lambda c, n: (F.round(c, n) + 0.0)
    return x.select("bucket", "n", shown("min_tone", 4).alias("min_tone"), shown("mean_tone", 7).alias("mean_tone"), "most", shown("conflict_ratio", 7).alias("conflict_ratio"), shown(F.col("pooled")[0], 7).alias("first"), shown(total, 5).alias("total"))


# --- streams in event order -------------------------------------------------------------------------------------------


def _in_parts(rows: DataFrame, time: str, hours: int, late: int, source: str):
    """Writes rows to a folder in parts, as they might arrive up to `late` hours after their time, shuffled; yields after each part."""
    delay = F.pmod(F.xxhash64(*rows.columns[:2], time), F.lit(late * 3600))
    arrival = F.floor((F.unix_seconds(F.col(time)) + delay) / (hours * 3600))
    told = kept(rows.withColumn("_part", arrival))
    for part in [r[0] for r in told.select("_part").distinct().orderBy("_part").collect()]:  # a number a part
        told.where(F.col("_part") == part).drop("_part").write.mode("append").parquet(source)
        yield part


#: Milliseconds that a key may be idle in these queries: none leaves before its stream's end, as none does in the SQL.
IDLE = 10**12


def _arrived(spark, rows: DataFrame, last: DataFrame, key: str, order: list[str], advance, new: str, groups: int | None = None) -> DataFrame:
    """The results of a stream whose rows arrive in three parts of ten days or so, up to a day late; `last` moves the time on at the end."""
    folder = shared_folder(spark)
    source = f"{folder}/source"
    stream = lambda: ordered.in_order(spark.readStream.schema(rows.schema).parquet(source), key, "ts", order, "25 hours", advance, new, IDLE, groups)
    out = None
    for _ in _in_parts(rows, "ts", 24 * 11, 24, source):
        out = ordered.with_timers(spark, lambda: drained(stream(), folder=f"{folder}/out"))
    last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(source)
    out = ordered.with_timers(spark, lambda: drained(stream(), folder=f"{folder}/out"))
    return out.where(F.col("ts") < F.lit("2100-01-01").cast("timestamp"))


@query(f"WITH {TICKS} SELECT ticker, tick_id, round({cum('price')}, 5) + 0 AS z FROM ticks")
def stream_in_order(spark, d):
    """The running z-score over ticks that arrive shuffled and late, in several runs of one stream."""
    x = ticks(spark, d).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "tick_id", "price")
    last = spark.range(1).select(F.lit("end").alias("ticker"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.col("id").alias("tick_id"), F.lit(0.0).alias("price"))
    return rounded(_arrived(spark, x, last, "ticker", ["tick_id"], ordered.running_zscore("price"), "z double").select("ticker", "tick_id", "z"), 5)


CONV = [0.5, 0.3, 0.2]
#: Groups that the users are dealt into.
GROUPS = 1024


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, 0.5 * value + 0.3 * coalesce(lag(value, 1) OVER w,
  0) + 0.2 * coalesce(lag(value, 2) OVER w, 0) AS u, 0.05 + (event_id % 7) / 40.0 AS dt,
  (event_id % 5) / 4.0 AS b1, (event_id % 4) / 3.0 AS b2, (event_id % 3) / 2.0 AS c1, row_number() OVER w AS i
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, i, event_id, u, c1, dt * b1 * u AS h1, dt * b2 * u AS h2 FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i,
  n.event_id, n.u, n.c1, exp(-n.dt) * h1 + n.dt * n.b1 * n.u, exp(-2 * n.dt) * h2 + n.dt * n.b2 * n.u
  FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1) SELECT user_id, event_id, round(u, 8) AS conv, round(c1 * h1 + h2 + 0.25 * u,
  8) + 0 AS y FROM s""")
def stream_conv_scan(spark, d):
    """A causal convolution and a selective scan of its results as a stream: the state is two values and two numbers a user."""
    id_ = F.col("event_id")
    x = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", (0.05 + (id_ % 7) / 40.0).alias("dt"))
    x = x.withColumns({"b": F.array((id_ % 5) / 4.0, (id_ % 4) / 3.0), "c": F.array((id_ % 3) / 2.0, F.lit(1.0))})
    last = x.limit(1).withColumns({"user_id": F.lit(-1), "ts": F.lit("2100-01-01").cast("timestamp")})
    y = _arrived(spark, x, last, "user_id", ["event_id"], ordered.conv_and_scan("value", CONV, "dt", [-1.0, -2.0], "b", "c", 0.25), "conv double, y double", GROUPS)
    return rounded(y.select("user_id", "event_id", "conv", "y"), 8)


# --- stores and transfers ---------------------------------------------------------------------------------------------


def _store_of_orders(spark, d) -> str:
    """Order numbers as lines of text, a folder a year."""
    folder = f"{shared_folder(spark)}/orders"
    t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("line")).write.partitionBy("year").text(folder)
    return folder


@query("""SELECT 'year=' || year(o_orderdate) AS folder, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM orders
  WHERE year(o_orderdate) BETWEEN 1997 AND 1999 GROUP BY 1""")
def paged_listing(spark, d):
    """A store listed in pages of two objects, folders by executors; the filter on the key's start narrows the prefix that is asked for."""
    keys = store.listed(spark, _store_of_orders(spark, d), page_size=2).where("key like 'year=199%' and key like '%.txt'")
    years = files.of_years(keys.withColumn("path", F.regexp_replace("key", "year=", "")), 1997, 2100, path="path", keep_unknown=False)
    return years.groupBy(F.substring_index("key", "/", 1).alias("folder")).agg(F.sum("size").alias("bytes"))


@query("""SELECT 'year=' || year(o_orderdate) AS folder, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes,
  CAST(0 AS BIGINT) AS differing, true AS first_run, true AS second_run, false AS third_run FROM orders GROUP BY 1""")
def incremental_copy(spark, d):
    """A store copied in two runs, by years and then the rest; a third run moves nothing. Sizes as the target lists them, and how many keys differ."""
    source, target = _store_of_orders(spark, d), f"{shared_folder(spark)}/copy"
    here, there = (lambda: store.listed(spark, source).where("key like '%.txt'")), (lambda: store.listed(spark, target).where("key like '%.txt'"))
    moved = [store.transfer(spark, x, there(), source, target, 1 << 16) for x in (here().where("key like 'year=1996/%'"), here(), here())]
    out = there().groupBy(F.substring_index("key", "/", 1).alias("folder")).agg(F.sum("size").alias("bytes"))
    both = here().select("key", "size").exceptAll(there().select("key", "size")).count()
    runs = {n: F.lit(m > 0) for n, m in zip(("first_run", "second_run", "third_run"), moved, strict=True)}
    return out.withColumns({"differing": F.lit(both).cast("long")} | runs)


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END),
  2) AS "F", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS "O",
  round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS "P" FROM orders
  WHERE o_orderdate >= DATE '1995-06-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1""")
def series_by_service(spark, d):
    """Series as a service answers for them, one document each, read by a partition a series; bounds on the date reach the request."""
    folder = shared_folder(spark)
    x = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    line = F.to_json(F.struct(F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value")))
    x.select("series", line.alias("line")).write.partitionBy("series").text(folder)
    rows = macro_series.observations(spark, ["F", "O", "P"], base=folder).where("date >= date'1995-06-01' and date < date'1998-01-01'")
    wide = macro_series.as_columns(rows, ["F", "O", "P"])
    return rounded(wide.withColumnRenamed("date", "day"), 2)


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(max(value), 4) AS high FROM events
  WHERE ts >= '2024-01-05' AND ts < '2024-01-21' GROUP BY 1""")
def files_by_name(spark, d):
    """A file a day named by it, days in range read by name; hidden files beside them are not."""
    folder = shared_folder(spark)
    e = t(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "value")
    e.write.partitionBy("day").parquet(f"{folder}/parts")
    store.renamed_by_partition(spark, f"{folder}/parts", "day", f"{folder}/days")
    x = files.daily_parquet(spark, f"{folder}/days", "2024-01-05", "2024-01-20")
    return rounded(x.groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("high")))


@query("""WITH x AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS gold, avg(l_extendedprice) AS oil,
  avg(l_extendedprice * l_tax) / 1e4 AS hy, avg(l_extendedprice * l_discount) / 1e4 AS ig, max(l_quantity) AS bbb,
  min(l_quantity) AS aaa, avg(l_quantity * l_tax) AS real,
  avg(l_quantity * l_discount) AS infl, sum(l_quantity) AS dollar, max(l_tax) * 100 AS vix, avg(l_linenumber) - 3 AS stress
  FROM lineitem GROUP BY 1)
  SELECT CAST(day AS VARCHAR) AS day, round(gold / lag(gold, 5) OVER w - 1, 7) + 0 AS gold_ret_5d,
  round((gold - avg(gold) OVER w20) / stddev_samp(gold) OVER w20, 5) + 0 AS gold_z_20d, round(oil / lag(oil, 20) OVER w - 1,
  7) + 0 AS oil_ret_20d,
  round(hy - lag(hy, 5) OVER w, 11) + 0 AS hy_oas_chg_5d, round(hy - ig, 11) + 0 AS hy_ig_diff, round(hy / CASE WHEN ig = 0
  THEN 1 ELSE ig END, 7) AS hy_ig_ratio, round(bbb - aaa, 6) AS bbb_aaa_spread, round(real - lag(real, 5) OVER w,
  7) + 0 AS real_yield_chg_5d,
  round(infl - lag(infl, 5) OVER w, 7) + 0 AS infl_exp_chg_5d, round(dollar / lag(dollar, 5) OVER w - 1, 7) + 0 AS dollar_ret_5d,
  round(vix - lag(vix, 1) OVER w, 6) + 0 AS vix_chg_1d,
  CASE WHEN count(hy) OVER w252 >= 252 AND hy > quantile_cont(hy, 0.9) OVER w252 THEN 1e0 ELSE 0 END AS credit_stress,
  CASE WHEN stress > 0 THEN 1e0 ELSE 0 END AS fin_stress_elevated FROM x
  WINDOW w AS (ORDER BY day), w20 AS (ORDER BY day ROWS 19 PRECEDING),
  w252 AS (ORDER BY day ROWS 251 PRECEDING) QUALIFY row_number() OVER w > 20""")
def cross_asset(spark, d):
    """Returns, changes, spreads, ratios and stress flags across assets, from the first day on which all of them are known."""
    a = lambda f, c, n: f(c).alias(n)
    q, x = F.col("l_quantity"), t(spark, d, "lineitem")
    x = x.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        a(F.avg, q, "gold"), a(F.avg, "l_extendedprice", "oil"), (F.avg(F.col("l_extendedprice") * F.col("l_tax")) / 1e4).alias("hy"), (F.avg(F.col("l_extendedprice") * F.col("l_discount")) / 1e4).alias("ig"), a(F.max, q, "bbb"), a(F.min, q, "aaa"), a(F.avg, q * F.col("l_tax"), "real"), a(F.avg, q * F.col("l_discount"), "infl"),
        a(F.sum, q, "dollar"), (F.max("l_tax") * 100).alias("vix"), (F.avg("l_linenumber") - 3).alias("stress"),
    )
    w = Window.orderBy("day")  # a row a calendar day
    made = macro.cross_asset({c: F.col(c) for c in x.columns if c != "day"}, w)
    x = x.select("day", F.row_number().over(w).alias("n"), *[v.alias(k) for k, v in made.items()]).where("n > 20").drop("n")
    places = {"gold_z_20d": 5, "hy_oas_chg_5d": 11, "hy_ig_diff": 11, "bbb_aaa_spread": 6, "vix_chg_1d": 6}
    names = "gold_ret_5d gold_z_20d oil_ret_20d hy_oas_chg_5d hy_ig_diff hy_ig_ratio bbb_aaa_spread real_yield_chg_5d infl_exp_chg_5d dollar_ret_5d vix_chg_1d credit_stress fin_stress_elevated".split()
    return x.select(F.col("day").cast("string").alias("day"), *[(F.round(n, places.get(n, 7)) + 0.0).alias(n) for n in names])


@query(f"""WITH {MACRO_SQL}, f AS (SELECT day, dgs30 - dgs3mo AS ff, CASE WHEN ig <> 0 THEN hy / ig END AS ratio FROM m),
  e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 400000 OR day(o_orderdate) = 15),
  p AS (SELECT f.*, (SELECT max(e.day) FROM e WHERE e.day <= f.day) AS last, (SELECT min(e.day) FROM e WHERE e.day > f.day) AS next FROM f)
  SELECT CAST(day AS VARCHAR) AS day, round(ff, 7) + 0 AS ff_3m_spread,
  round(coalesce(last_value(ratio IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 1), 7) AS vix_term_ratio,
  CAST(coalesce(day - last, 365) AS INTEGER) AS days_since_fomc,
  CAST(coalesce(next - day, 45) AS INTEGER) AS days_until_fomc, coalesce(next - day, 45) <= 7 OR coalesce(day - last,
  365) <= 2 AS is_fomc_week FROM p""")
def macro_fed(spark, d):
    """The fed-funds spread, the term ratio carried over gaps, and the week of a meeting by the second rule."""
    m, w = _macro(spark, d)
    o = t(spark, d, "orders").where((F.col("o_totalprice") > 400000) | (F.dayofmonth("o_orderdate") == 15)).select(F.lit(0).alias("all"), F.to_date("o_orderdate").alias("day"))
    c = F.col
    x = m.select("day", F.lit(0).alias("all"), *[v.alias(k) for k, v in macro.funds_and_term(c("dgs30"), c("dgs3mo"), c("hy"), c("ig"), w).items()])
    at = macro.meetings(x, o, "all", "day", since_default=365, until_default=45)
    week = (F.col("days_to") <= 7) | (F.col("days_since") <= 2)
    return rounded(at.select("day", "ff_3m_spread", "vix_term_ratio", F.col("days_since").alias("days_since_fomc"), F.col("days_to").alias("days_until_fomc"), week.alias("is_fomc_week")), 7)
