"""Streams with state in event order: shuffled and late rows over many batches, restarts, keys that leave the store."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import rolling as R
from tidemark.streaming import ordered as T
from tidemark.streaming.sinks import drained

START = dt.datetime(2024, 1, 1)
KINDS = "k string, ts timestamp, i long, v double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def feed(spark, folder, batch, kinds=KINDS):
    spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, folder, advance, new, late="1 hour", kinds=KINDS, idle_ms=10**12):
    stream = spark.readStream.schema(spark.createDataFrame([], kinds).schema).option("maxFilesPerTrigger", 1).parquet(source)
    return T.with_timers(spark, lambda: drained(T.in_order(stream, "k", "ts", ["i"], late, advance, new, idle_ms), folder=folder))


def test_shuffled_and_late_rows_equal_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), at(3 * i), i, None if i % 17 == 0 else rnd.gauss(0, 1)) for i in range(300)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    pending = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 50)))  # up to 50 minutes late
    for n in range(0, 300, 75):
        feed(spark, source, pending[n : n + 75])
        run(spark, source, folder, T.running_zscore("v"), "z double")  # stops and goes on each time
    feed(spark, source, [("a", at(10), -1, 99.0), ("end", at(10**5), 0, 0.0)])  # far too late: dropped; and one to move the watermark
    got = {r.i: r.z for r in run(spark, source, folder, T.running_zscore("v"), "z double").where("k != 'end'").collect()}
    batch = spark.createDataFrame(rows, KINDS)
    want = {r.i: r.z for r in batch.select("i", F.coalesce(R.cumulative_zscore(F.col("v"), R.series(["k"], ["ts", "i"])), F.lit(0.0)).alias("z")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)


def test_idle_keys_leave_the_store(spark, tmp_path):
    """A key without rows for an hour starts anew, and its state is gone from the store."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    z = lambda: run(spark, source, folder, T.running_zscore("v"), "z double", late="1 minute", idle_ms=3_600_000)
    feed(spark, source, [("a", at(i), i, float(i)) for i in range(5)] + [("b", at(i), 100 + i, 1.0) for i in range(5)])
    z()
    feed(spark, source, [("b", at(60 * n), 200 + n, 1.0) for n in range(1, 6)])
    z()
    feed(spark, source, [("b", at(600), 300, 1.0)])
    z()
    held = spark.read.format("statestore").option("stateVarName", "state").load(f"{folder}/state")
    assert {r.key.k for r in held.select("key").collect()} == {"b"}
    feed(spark, source, [("a", at(660), 400, 7.0), ("end", at(10**5), 0, 0.0)])
    got = {r.i: r.z for r in z().collect()}
    assert got[400] == 0.0 and got[4] != 0.0 and {0, 1, 2, 3, 4, 100, 300} <= got.keys()


def test_convolution_and_scan_go_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(7)
    rates, weights, kinds = [-0.5, -1.0, -2.0], [0.5, 0.3, 0.2], "k string, ts timestamp, i long, x double, dt double, b array<double>, c array<double>"
    rows = [(rnd.choice("ab"), at(i), i, None if i % 31 == 0 else rnd.gauss(0, 1), rnd.random(), [rnd.random() for _ in rates], [rnd.random() for _ in rates]) for i in range(200)]
    want, state = {}, {k: ([0.0, 0.0], np.zeros(3)) for k in "ab"}
    for k, _, i, x, d, b, c in rows:
        past, h = state[k]
        u = weights[0] * (x or 0.0) + weights[1] * past[-1] + weights[2] * past[-2]
        h = np.exp(d * np.array(rates)) * h + d * np.array(b) * u
        want[i], state[k] = (u, float(np.dot(c, h)) + 0.1 * u), ([past[-1], x or 0.0], h)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    pending = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 20)))
    advance = lambda: T.conv_and_scan("x", weights, "dt", rates, "b", "c", 0.1)
    for n in (0, 100):
        feed(spark, source, pending[n : n + 100], kinds)
        run(spark, source, folder, advance(), "conv double, y double", "30 minutes", kinds)
    feed(spark, source, [("end", at(10**5), 0, 0.0, 0.0, [0.0] * 3, [0.0] * 3)], kinds)
    got = {r.i: (r.conv, r.y) for r in run(spark, source, folder, advance(), "conv double, y double", "30 minutes", kinds).where("k != 'end'").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_rows_wait_as_entries_of_many(spark, tmp_path):
    """Forty rows of a key that wait lie in one entry of its list, and in one again after a part of them has gone."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    z = lambda: run(spark, source, folder, T.running_zscore("v"), "z double", late="20 minutes")
    feed(spark, source, [("a", at(i), i, float(i)) for i in range(40)])
    assert z().count() == 20  # up to the watermark, at 19 minutes
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{folder}/state")
    assert held.count() == 1


def test_many_keys_in_groups(spark, tmp_path):
    """Forty keys in three groups, over a restart: results as of keys by themselves, and the store holds groups. What isn't finite stays with its key."""
    rnd = random.Random(11)
    rates, weights, kinds = [-0.5, -2.0], [0.5, 0.3, 0.2], "k string, ts timestamp, i long, x double, dt double, b array<double>, c array<double>"
    rows = [(f"k{rnd.randrange(40)}", at(i), i, None if i % 31 == 0 else rnd.gauss(0, 1), rnd.random(), [rnd.random() for _ in rates], [rnd.random() for _ in rates]) for i in range(600)]
    rows[300] = ("k7", at(300), 300, math.inf, 9.0, [9.0, 9.0], [9.0, 9.0])
    pending = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 20)))
    end = [("end", at(10**5), 0, 0.0, 0.0, [0.0] * 2, [0.0] * 2)]

    def seen(groups):
        source, folder = str(tmp_path / f"in{groups}"), str(tmp_path / f"out{groups}")
        stream = lambda: spark.readStream.schema(spark.createDataFrame([], kinds).schema).parquet(source)
        advance = lambda: T.conv_and_scan("x", weights, "dt", rates, "b", "c", 0.1)
        for batch in (pending[:300], pending[300:], end):
            feed(spark, source, batch, kinds)
            out = T.with_timers(spark, lambda: drained(T.in_order(stream(), "k", "ts", ["i"], "30 minutes", advance(), "conv double, y double", 10**12, groups), folder=folder))
            if groups and batch is not end:
                for held in ("waiting", "state"):
                    assert spark.read.format("statestore").option("stateVarName", held).load(f"{folder}/state").count() <= groups
        return {r.i: (r.conv, r.y) for r in out.where("k != 'end'").collect()}

    by_group, by_key = seen(3), seen(None)
    assert by_group.keys() == by_key.keys() == {r[2] for r in rows}
    assert all(np.array_equal(by_group[i], by_key[i], equal_nan=True) for i in by_key)
    strange = {i for i, v in by_key.items() if not np.isfinite(v).all()}
    assert strange <= {r[2] for r in rows if r[0] == "k7" and r[2] >= 300}


def test_one_key_of_a_group_leaves(spark, tmp_path):
    """A key without rows for an hour starts anew; another of its group, and one whose rows wait, go on."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def z():
        stream = spark.readStream.schema(spark.createDataFrame([], KINDS).schema).option("maxFilesPerTrigger", 1).parquet(source)
        return T.with_timers(spark, lambda: drained(T.in_order(stream, "k", "ts", ["i"], "1 minute", T.running_zscore("v"), "z double", 3_600_000, 1), folder=folder))

    feed(spark, source, [(k, at(i), 100 * n + i, float(i)) for n, k in enumerate("abc") for i in range(5)])
    z()
    feed(spark, source, [("b", at(30 * n), 300 + n, 1.0) for n in range(1, 11)])
    z()
    feed(spark, source, [("b", at(310), 320, 1.0), ("c", at(310), 321, 5.0)])
    z()
    feed(spark, source, [("a", at(330), 400, 7.0), ("b", at(330), 401, 7.0), ("end", at(10**5), 0, 0.0)])
    got = {r.i: r.z for r in z().collect()}
    assert got[400] == 0.0 and got[401] != 0.0 and {4, 104, 204, 310, 320, 321} <= got.keys()


def test_a_key_silent_for_weeks_goes_on(spark, tmp_path):
    """The SQL of the queries over events knows no idle keys."""
    import duckdb

    from tidemark.plans import series

    seen = [(5, d) for d in (0, 1, 28)] + [(6, d) for d in (2, 13, 29)] + [(7, d) for d in range(30)]  # the last moves the watermark on
    rows = [(n, START + dt.timedelta(days=d, seconds=n), user, f"t{user}", 1.5 * n + d * d, "{}") for n, (user, d) in enumerate(seen)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("stream_conv_scan", "stream_in_order"):
        got = sorted(map(tuple, series.QUERIES[name](spark, str(tmp_path)).collect()))
        want = sorted(c.sql(series.SQL[name]).fetchall())
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
