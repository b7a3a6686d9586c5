"""Edges of the operators on hand-made rows."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof as A
from tidemark.operators import bars as B
from tidemark.operators import cleaning as K
from tidemark.operators import ordered as O
from tidemark.operators import rolling as R
from tidemark.operators import scores as C
from tidemark.operators import sequences as Q
from tidemark.operators import statements as N


def test_parse_value(spark):
    texts = {"0.3%": 0.3, "120K": 120e3, "16.5M": 16.5e6, "-785M": -785e6, "3.94|1.8": 3.94, "54.8": 54.8, "": None, "abc": None}
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", S.parse_value(F.col("x")).alias("y")).collect()}
    assert got == texts


def test_clean_and_ratio(spark):
    x = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in x.select(S.clean(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.0]
    assert [r[0] for r in x.select(S.ratio(F.lit(1.0), F.lit(0.0))).collect()] == [0.0] * 4


def test_third_friday(spark):
    days = [(dt.date(2024, 3, 1), dt.date(2024, 3, 15)), (dt.date(2024, 6, 30), dt.date(2024, 6, 21))]
    x = spark.createDataFrame(days, "day date, want date")
    assert all(r.want == r.got for r in x.withColumn("got", S.third_friday(F.col("day"))).collect())


def test_small_bars(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, i), i, p, v) for i, (p, v) in enumerate([(1.0, 0.0), (1.0, 0.0), (1.0, 0.0)])] + [("b", dt.datetime(2024, 1, 1), 1, 5.0, 2.0)]
    out = {r.ticker: r for r in B.bars(spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, tick_id long, price double, volume double"), "2 minutes").collect()}
    assert out["a"].price_skew == 0 and out["a"].vwap == 1.0 and out["b"].price_std == 0 and out["b"].vwap == 5.0


def test_rolling_needs_full_window(spark):
    x = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, i int, v double")
    w = R.series(["k"], ["i"])
    assert [r[0] for r in x.orderBy("i").select(R.rolling(F.avg("v"), F.col("v"), 3, w)).collect()] == [None, None, 1.0, 2.0, 3.0]


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0)], "k string, t int, v double")
    assert {(r.k, r.t): r.v for r in A.asof(left, right, ["k"], "t", ["v"]).collect()} == {("a", 1): None, ("a", 5): 2.0, ("b", 5): None}
    assert {(r.k, r.t): r.v for r in A.asof(left, right, ["k"], "t", ["v"], forward=True).collect()} == {("a", 1): 1.0, ("a", 5): 2.0, ("b", 5): None}
    assert A.asof(left, right.where("false"), ["k"], "t", ["v"]).where("v is not null").count() == 0


def test_state_age(spark):
    f = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0)], "ticker int, filed date, revenue double")
    d = spark.createDataFrame([(dt.date(2024, 6, 29),), (dt.date(2024, 6, 30),)], "day date")
    assert [str(r.day) for r in A.state_at(d, f, "ticker", "day", "filed").collect()] == ["2024-06-29"]


def test_nearest_later_day_wins(spark):
    day = dt.date(2024, 1, 1)
    anchors = spark.createDataFrame([(day,)], "day date")
    targets = spark.createDataFrame([(day + dt.timedelta(6), 1.0), (day + dt.timedelta(8), 2.0)], "day date, value double")
    assert A.nearest_day(anchors, targets, "day", 7).first().target_value == 2.0


def test_upsert_and_scan(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, Q.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_scan_of_many_keys_and_nulls(spark):
    rows = [(k, i, None if i == 3 else float(i)) for k in (None, 1, 2) for i in range(50)]
    x = spark.createDataFrame(rows, "k int, i int, x double").withColumns({"d": F.lit(0.5), "cell": F.floor(F.col("i") / 7), "b": F.array(F.col("i") % 2 + 1.0, F.lit(0.5)), "c": F.array(F.lit(1.0), F.col("i") % 3 + 0.0)})
    got = {(r.k, r.i): r.y for r in Q.selective_scan(x, ["k"], "cell", ["i"], "x", "d", [-1.0, -2.0], "b", "c", 0.1, "y").collect()}
    assert len(got) == len(rows)
    for k in (None, 1, 2):
        h = [0.0, 0.0]
        for i in range(50):
            v = 0.0 if i == 3 else float(i)
            h = [h[n] * math.exp(-0.5 * (n + 1)) + 0.5 * (i % 2 + 1.0, 0.5)[n] * v for n in (0, 1)]
            assert abs(got[k, i] - h[0] - i % 3 * h[1] - 0.1 * v) < 1e-9


def test_two_level_windows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), i // 3, i, rnd.choice([None, 1.0, 2.0])) for i in range(200)]
    x = spark.createDataFrame(rows, "k string, cell int, i int, v double")
    series = {k: [r for r in rows if r[0] == k] for k in ("a", "b", None)}
    nth = {r.i: r.n for r in O.numbered(x, ["k"], "cell", ["i"], "n").collect()}
    last = {r.i: r.before for r in O.lagged(x, ["k"], "cell", ["i"], "v", "before").collect()}
    for own in series.values():
        for n, r in enumerate(own):
            assert nth[r[2]] == n + 1 and last[r[2]] == (own[n - 1][3] if n else None)


def test_asof_in_cells(spark):
    rnd = random.Random(2)
    left = spark.createDataFrame([(rnd.choice("ab"), rnd.randrange(300)) for _ in range(120)], "k string, t int").distinct()
    right = spark.createDataFrame([(rnd.choice("ab"), rnd.randrange(300), float(i)) for i in range(25)], "k string, t int, v double").dropDuplicates(["k", "t"])
    for forward in (False, True):
        plain, split = (sorted(map(str, A.asof(left, right, ["k"], "t", ["v"], forward, cell).collect())) for cell in (None, lambda c: F.floor(c / 10)))
        assert plain == split


def test_percentile_of_long_windows(spark):
    rnd = random.Random(3)
    values = [float(rnd.randrange(20)) for _ in range(150)]
    x = spark.createDataFrame([("a", i // 11, i, v) for i, v in enumerate(values)], "k string, cell int, i int, v double")
    got = {r.i: r.p for r in R.percentile_of_long(x, "v", ["k"], "cell", ["i"], 40, "p").collect()}
    for i, v in enumerate(values):
        assert got[i] == (None if i < 39 else sum(y <= v for y in values[i - 39 : i + 1]) / 40)


def test_scalars_of_features(spark):
    x = spark.createDataFrame([("['A', 'B']", "M", "7"), ("", "x", "12345678901"), (None, None, None)], "l string, o string, z string")
    got = x.select(S.parse_list(F.col("l")).alias("l"), S.ordinal(F.col("o")).alias("o"), S.zero_pad(F.col("z")).alias("z")).collect()
    assert [(r.l, r.o, r.z) for r in got] == [(["A", "B"], 2, "0000000007"), ([], 0, "12345678901"), (None, 0, None)]
    one = spark.range(1)
    assert one.select(S.from_epoch_ns(F.lit(1_700_000_000_123_456_789)).cast("string")).first()[0] == "2023-11-14 22:13:20.123456"
    assert one.select(S.first_range(F.lit(7375), [(7000, 7400, "a"), (7370, 7380, "b")], "none")).first()[0] == "a"
    assert [one.select(S.surprise(F.lit(a), F.lit(b))).first()[0] for a, b in ((3.0, -2.0), (1.0, 0.0))] == [250.0, 0.0]


def test_contract_and_outer_join(spark):
    x = spark.createDataFrame([(1, 2.0)], "k int, close double")
    assert K.to_contract(x, ["k", "vwap", "close"]).columns == ["k", "close"] and K.to_contract(x, ["k", "vwap"], fill=True).first().vwap == 0.0
    y = spark.createDataFrame([(2, 5.0, 1.0)], "k int, close double, v double")
    assert sorted(map(tuple, K.outer_all([x, y], ["k"]).collect()), key=str) == [(1, 2.0, None), (2, None, 1.0)]


def test_latest_value_of_each_column(spark):
    day = lambda m, d: dt.date(2024, m, d)
    f = spark.createDataFrame([(1, day(1, 5), 1.0, None), (1, day(2, 5), None, 2.0), (1, day(3, 20), 9.0, 9.0)], "k int, filed date, a double, b double")
    got = N.latest_values(spark.createDataFrame([(day(3, 1),), (day(8, 1),)], "day date"), f, "k", "day", "filed", ["a", "b"])
    assert sorted((str(r.day), r.a, r.b) for r in got.collect()) == [("2024-03-01", 1.0, 2.0), ("2024-08-01", 9.0, 9.0)]


def test_sessions_of_a_stream(spark, tmp_path):
    from tidemark.streaming.bars import sessions
    from tidemark.streaming.sinks import drained

    rows = [("a", dt.datetime(2024, 1, 1, 0, m)) for m in (0, 5, 50, 52)] + [("b", dt.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "ticker string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ticker string, ts timestamp").parquet(str(tmp_path / "in"))
    got = drained(sessions(stream, "20 minutes", "1 minute"), folder=str(tmp_path / "out"))
    assert sorted((r.ticker, r.n) for r in got.collect()) == [("a", 2), ("a", 2)]


def test_segment_sums(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 4])], "k string, i int, x int")
    assert {r.i: list(r.s) for r in Q.segment_sums(x, ["k"], ["i"], "x", "s").collect()} == {0: [0], 1: [2, 0], 2: [6, 4, 0]}


def test_filter_scores(spark):
    x = spark.createDataFrame([("a", i, s) for i, s in enumerate([3.0, 2.0, 2.0, 1.0, None])], "k string, t int, s double")
    kept = lambda **o: sorted(r.t for r in C.filter_scores(x, ["k"], "t", "s", **o).where("kept").collect())
    assert kept() == [0, 1, 2, 3] and kept(top_k=2) == [0, 1, 2] and kept(top_k=1) == [0]
    assert kept(top_p=0.5) == [0] and kept(min_p=0.3) == [0, 1, 2]
    seen = C.filter_scores(x.withColumn("old", F.col("t") == 0), ["k"], "t", "s", seen="old", penalty=2.0, temperature=0.5)
    assert {r.t: r.logit for r in seen.collect()} == {0: 3.0, 1: 4.0, 2: 4.0, 3: 2.0, 4: None}
    assert abs(seen.agg(F.sum("prob")).first()[0] - 1) < 1e-12


def test_early_stop(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.5, 1.0])], "k string, i int, v double")
    assert [(r.best, r.since, r.stopped) for r in C.early_stop(x, ["k"], "i", "v", 2).orderBy("i").collect()] == [(3.0, 0, False), (2.0, 0, False), (2.0, 1, False), (2.0, 2, True), (1.0, 0, True)]


def test_pooled_buckets_of_extreme_scores(spark):
    """Scores of 700 either way, ties, a bucket of one row, null scores and vectors, a null key, empty buckets and an empty table."""
    import numpy as np

    from tidemark.operators import pooling as U

    rnd = random.Random(5)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(4)], rnd.choice([-700.0, 0.0, 699.5, 700.0])) for k in ("a", "b", None) for _ in range(200)]
    rows += [("one", [1.0, 2.0, 3.0, 4.0], -1e6), ("a", None, 800.0), ("a", [9.0] * 4, None)]
    x = spark.createDataFrame(rows, "k string, v array<double>, s double").repartition(7)
    got = {r.k: list(r.pooled) for r in U.softmax_vectors(x, ["k"], "v", "s").collect()}
    for k in ("a", "b", None, "one"):
        mine = [(v, s) for key, v, s in rows if key == k and v is not None and s is not None]
        w = np.exp(np.array([s for _, s in mine]) - max(s for _, s in mine))
        assert np.allclose(got[k], (w[:, None] * np.array([v for v, _ in mine])).sum(0) / w.sum())
    buckets = spark.createDataFrame([("a",), ("empty",), (None,)], "k string")
    full = {r.k: r for r in U.pooled_buckets(x, buckets, ["k"], "v", "s", {"least": F.min("s"), "share": F.avg((F.col("s") > 0).cast("double"))}, 4).collect()}
    assert full.keys() == {"a", "empty", None} and full["a"].n == 202 and full["a"].least == -700.0 and np.allclose(full[None].pooled, got[None])
    assert (full["empty"].n, list(full["empty"].pooled), full["empty"].least, full["empty"].share) == (0, [0.0] * 4, 0.0, 0.0)
    assert U.softmax_vectors(x.limit(0), ["k"], "v", "s").count() == 0


def test_cross_asset_of_what_is_there(spark):
    from tidemark.operators import macro as M

    w = R.series(["k"], ["i"])
    x = spark.createDataFrame([("a", i, float(i + 1), 2.0 if i else 0.0) for i in range(30)], "k string, i int, hy double, ig double")
    made = M.cross_asset({"hy": F.col("hy"), "ig": F.col("ig")}, w)
    assert set(made) == {"hy_oas_chg_5d", "ig_oas_chg_5d", "hy_oas_z_60d", "credit_stress", "hy_ig_diff", "hy_ig_ratio"}
    got = {r.i: r for r in x.select("i", *[v.alias(k) for k, v in made.items()]).collect()}
    assert got[0].hy_ig_ratio == 1.0 and got[29].hy_ig_ratio == 15.0 and got[29].hy_oas_chg_5d == 5.0 and got[4].hy_oas_chg_5d is None and got[29].credit_stress == 0.0
    both = M.funds_and_term(F.col("hy"), F.col("ig"), F.col("hy"), F.col("ig"), w)
    term = {r.i: r.vix_term_ratio for r in x.select("i", both["vix_term_ratio"].alias("vix_term_ratio")).collect()}
    assert term[0] == 1.0 and term[3] == 2.0


def test_means_at_a_rounding_tie(spark):
    """The mean is 50.67775, whatever the order of summation; values without a decimal of ten places take the usual mean."""
    values = [0.1] * 3 + [0.7, 0.3] * 40 + [3.3, 1.1, 9.9] * 11 + [0.01] * 3
    values.append(round(50.67775 * (len(values) + 1) - sum(values), 2))
    assert len(values) == 120
    rows = [(k, v, i) for k, order in (("up", sorted(values)), ("down", sorted(values)[::-1]), ("as", values)) for i, v in enumerate(order)]
    rows += [("nan", float("nan"), 0), ("nan", 1.0, 1), ("large", 1e30, 0), ("large", 3e30, 1), ("none", None, 0), ("some", None, 0), ("some", 2.5, 1)]
    x = spark.createDataFrame(rows, "k string, v double, i int").repartition(1).sortWithinPartitions("k", "i")
    got = {r.k: r.m for r in x.groupBy("k").agg(F.round(S.exact_mean(F.col("v")), 4).alias("m")).collect()}
    assert [got[k] for k in ("up", "down", "as")] == [50.6778] * 3
    assert got["nan"] != got["nan"] and got["large"] == 2e30 and got["none"] is None and got["some"] == 2.5
    usual = {r.k: r.m for r in x.where("k in ('up', 'down', 'as')").groupBy("k").agg(F.round(F.avg("v"), 4).alias("m")).collect()}
    assert set(usual.values()) != {50.6778}  # what made the difference


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_options_of_a_bar_without_sorting_all_rows(spark):
    """Ties at the last time go to the next columns of the order; a bar or a time may be null. No aggregate of all measures is sorted."""
    names = [c for c in dict.fromkeys([*B.OPTION_SUMS, *B.OPTION_MEANS, *B.OPTION_MAXES, *B.OPTION_LASTS])]
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None]), i, *[rnd.random() for _ in names]) for i in range(60)] + [("c", None, i, *[float(i)] * len(names)) for i in range(3)]
    x = spark.createDataFrame(rows, "k string, ts int, i int, " + ", ".join(f"{n} double" for n in names))
    got = {r.key: r for r in B.options_roll_up(x, [F.col("k").alias("key")], ["ts", "i"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        own = [dict(zip(["k", "ts", "i", *names], v)) for v in rows if v[0] == k]
        last = max(own, key=lambda v: (v["ts"] is not None, v["ts"] or 0, v["i"]))
        assert [r[c] for c in B.OPTION_LASTS] == [last[c] for c in B.OPTION_LASTS]
        assert all(math.isclose(r[c], sum(v[c] for v in own)) for c in B.OPTION_SUMS)
    plan = plan_of(B.options_roll_up(x, [F.col("k").alias("key")], ["ts", "i"]))
    assert "sum(" not in plan  # the sums were hashed before, apart from what is compared by struct


def test_latest_values_move_filings_once(spark):
    filings = spark.createDataFrame([(i % 7, dt.date(2024, 1 + i % 5, 1 + i % 28), float(i) if i % 3 else None) for i in range(100)], "k int, filed date, v double")
    assert N.by_company(filings, "k", each=30).rdd.getNumPartitions() == 4
    st = N.by_company(filings, "k", each=30).groupBy("k", "filed").agg(F.sum("v").alias("v"))
    dates = spark.createDataFrame([(dt.date(2024, m, 15),) for m in (2, 4, 9)], "day date")
    out = N.latest_values(dates, st, "k", "day", "filed", ["v"], 60)
    sums = {}
    for r in filings.collect():
        if r.v is not None:
            sums[r.k, r.filed] = sums.get((r.k, r.filed), 0.0) + r.v
    want = {}
    for (k, filed), v in sorted(sums.items()):
        for m in (2, 4, 9):
            if 0 <= (dt.date(2024, m, 15) - filed).days <= 60:
                want[dt.date(2024, m, 15), k] = v
    assert {(r.day, r.k): r.v for r in out.where("v is not null").collect()} == want
    assert plan_of(out).count("Exchange hashpartitioning") == 1
