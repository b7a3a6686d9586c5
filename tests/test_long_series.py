"""Windows, sums, scans, percentile ranks and quantiles of long series against the plain forms, with cells of all sizes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import long_series as L
from tidemark.operators import quantiles as Q
from tidemark.operators import rolling as R


@pytest.fixture(scope="module")
def rows(spark):
    """Two long series and a null key, in cells of one to some dozen rows; nulls among the values."""
    rnd = random.Random(2)
    out, i = [], 0
    for key, n in (("a", 700), (None, 90), ("b", 1), ("c", 40)):
        cell = -5
        for _ in range(n):
            cell += rnd.choice([0, 0, 0, 1, 1, 300_000])
            out.append((key, cell, i, None if rnd.random() < 0.05 else round(rnd.gauss(5, 2), 3), i + 1))
            i += 1
    return spark.createDataFrame(out, "k string, cell long, i long, v double, _nth long").repartition(4).persist()


def plain():
    return Window.partitionBy("k").orderBy("i")


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert len(a) == len(b) and all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def by_row(df, *columns):
    return [(r.i, *[r[c] for c in columns]) for r in df.collect()]


def test_numbers_and_sums(spark, rows):
    want = by_row(rows.withColumn("n", F.row_number().over(plain())), "n")
    close(by_row(L.numbered(rows.drop("_nth"), ["k"], "cell", ["i"], "n"), "n"), want)
    days = rows.drop("_nth").withColumn("cell", F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("i") / 7).cast("int")))
    close(by_row(L.numbered(days, ["k"], "cell", ["i"], "n"), "n"), want)
    assert L.numbered(rows.drop("_nth").limit(0), ["k"], "cell", ["i"], "n").count() == 0


@pytest.mark.parametrize("k", [1, 5, 64])
def test_frames_in_blocks(rows, k):
    """Blocks shorter and longer than the cells, window over window."""
    def build(df, w):
        df = df.withColumn("r", R.lag_diff(F.col("v"), 1, w))
        x = F.col("r")
        return df.withColumns({"rv": R.rolling_rv(x, k, w), "part": R.rolling_rv(x, k, w, 1), "sma": R.rolling(F.avg("v"), F.col("v"), k, w, 1), "p90": R.rolling(F.percentile("v", 0.9), F.col("v"), k, w, 1), "on": F.lead("v", 3).over(w)})

    columns = ["r", "rv", "part", "sma", "p90", "on"]
    want = by_row(build(rows.drop("_nth"), plain()), *columns)
    for block in (None, 7, 100):
        got = L.in_blocks(rows.drop("_nth"), ["k"], "cell", ["i"], k, build, after=3, rows=block)
        assert set(got.columns) == {"k", "cell", "i", "v", *columns}
        close(by_row(got, *columns), want)


def test_blocks_hold_few_rows(rows):
    dealt = L.blocks(rows.drop("_nth"), ["k"], "cell", ["i"], 10, rows=50)
    assert dealt.groupBy("k", "_block").count().agg(F.max("count")).first()[0] == 60
    assert dealt.where("_own").count() == rows.count()


def test_rv_chain_in_blocks(rows):
    horizons = {"rv_5m": (3, 1), "rv_15m": (8, 4), "rv_30m": (15, 7), "rv_1h": (30, 15), "rv_2h": (60, 30)}
    names = [*horizons, "rv_change_15", "rv_acceleration", "rv_zscore_1h", "rv_rank_2h"]
    want = by_row(R.rv_chain(rows.drop("_nth"), "v", plain(), horizons), *names)
    got = L.in_blocks(rows.drop("_nth"), ["k"], "cell", ["i"], 60, lambda df, w: R.rv_chain(df, "v", w, horizons), rows=61)
    close(by_row(got, *names), want)


def test_running_zscores(rows):
    x = rows.drop("_nth").withColumn("u", F.col("i") * 0.5)
    want = by_row(x.withColumn("z", F.when(F.col("v").isNotNull(), R.cumulative_zscore(F.col("v"), plain()))).withColumn("zu", R.cumulative_zscore(F.col("u"), plain())), "z", "zu")
    close(by_row(L.cumulative_zscore(x, ["k"], "cell", ["i"], {"v": "z", "u": "zu"}), "z", "zu"), want)


def test_scan_of_many_states_and_cells(spark):
    """Cells of one row, so that their states go up and down several levels; a long cell in pieces; nulls count as 0."""
    rnd = random.Random(3)
    rates, out, data = [-0.1 * (n + 1) for n in range(16)], {}, []
    for key, n in (("a", 2500), (None, 3), ("b", 1)):
        h = np.zeros(16)
        for i in range(n):
            x, dt, b, c = rnd.gauss(0, 1), rnd.random() / 4, [rnd.random() for _ in range(16)], [rnd.random() for _ in range(16)]
            x = None if i % 97 == 5 else x
            data.append((key, i if key else None, i, x, dt, b, c))
            h = np.exp(dt * np.array(rates)) * h + dt * np.array(b) * (x or 0.0)
            out[key, i] = float(np.dot(c, h) + 0.3 * (x or 0.0))
    df = spark.createDataFrame(data, "k string, cell long, i long, x double, dt double, b array<double>, c array<double>").withColumn("cell", F.coalesce("cell", F.lit(0)))
    for cells in (df, df.withColumn("cell", F.floor(F.col("i") / 2000)), df.withColumn("cell", F.col("i") * 1_000_003)):
        got = {(r.k, r.i): r.y for r in L.scan(cells, ["k"], "cell", ["i"], "x", "dt", rates, "b", "c", 0.3, "y").collect()}
        assert got.keys() == out.keys() and all(math.isclose(got[q], out[q], rel_tol=1e-9, abs_tol=1e-9) for q in out)
    assert L.scan(df.limit(0), ["k"], "cell", ["i"], "x", "dt", rates, "b", "c", 0.3, "y").count() == 0


def test_states_of_a_hundred_thousand_cells(spark):
    n = 100_000
    steps = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("cell"), F.array(F.lit(0.999), F.lit(0.5)).alias("a"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("b"))
    got = {r.cell: r.state for r in L.states_before(steps, ["k"], "cell", "a", "b").where("cell % 997 = 0 or cell = 99999").collect()}
    h = np.zeros(2)
    for i in range(n):
        if i in got:
            assert np.allclose(got[i], h)
        h = np.array([0.999, 0.5]) * h + [i % 7, 1.0]
    assert len(got) == 102


def test_percentile_ranks_of_long_windows(spark):
    k, n = 49_140, 100_000
    values = np.random.default_rng(1).integers(0, 5000, n)
    assert np.array_equal(L.ranks_within(values[:300], np.maximum(np.arange(300) - 49, 0), np.arange(300) + 1), [sum(values[max(i - 49, 0) : i + 1] <= values[i]) for i in range(300)])
    df = spark.createDataFrame([("a", i // 4096, i, float(v)) for i, v in enumerate(values.tolist())], "k string, cell long, i long, v double")
    got = {r.i: r.p for r in R.percentile_of_long(df, "v", ["k"], "cell", ["i"], k, "p").collect()}
    assert len(got) == n and all(got[i] is None for i in range(k - 1))
    for i in range(k - 1, n, 501):
        assert got[i] == np.count_nonzero(values[i - k + 1 : i + 1] <= values[i]) / k


def test_exact_quantiles(spark):
    """Ties in a third of the rows, heavy tails, few values, groups below and beyond what is sorted at once, null keys."""
    rnd = random.Random(8)
    groups = {"ties": [5.0] * 2000 + [rnd.gauss(5, 1) for _ in range(4000)], "tails": [math.exp(rnd.gauss(0, 40)) * rnd.choice([-1, 1]) for _ in range(5000)], "few": [float(rnd.randrange(3)) for _ in range(3000)],
              None: [rnd.random() for _ in range(2500)], "small": [3.0, 1.0], "one": [2.0], "none": [None, None], "same": [7.0] * 1000, "order": [float(i) for i in range(4001)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("few", None)], "k string, v double").repartition(5)
    wanted = {"least": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q90": 0.9, "most": 1.0}
    got = {r.k: [r[n] for n in wanted] for r in Q.exact_quantiles(df, ["k"], "v", wanted, few=20).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for k, vs in groups.items():
        if k != "none":
            assert np.allclose(got[k], np.quantile(vs, list(wanted.values())), rtol=1e-12), k
    assert Q.exact_quantiles(df.limit(0), ["k"], "v", wanted).count() == 0
    plain = {r.k: r.q50 for r in Q.exact_quantiles(df, ["k"], "v", {"q50": 0.5}).collect()}
    assert all(plain[k] == got[k][3] for k in got)
