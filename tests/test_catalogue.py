"""Every catalogue query against its SQL, on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue, features, series

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalogue.QUERIES | features.QUERIES | series.QUERIES, catalogue.SQL | features.SQL | series.SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def shown(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.12g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and not isinstance(v, bool) else str(v)

    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df)].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("lines", [
    [(1, 1, 3.0), (1, 1, None), (1, 2, 4.0), (1, 2, None)],
    [(1, None, 3.0), (1, 1, 5.0), (1, 2, 4.0)],
    [(1, 1, 2.9), (1, 1, 2.2), (1, 1, 2.4), (1, 2, 0.5), (1, 3, 1.5), (1, 4, -2.7)],
    [(1, 1, None), (1, 2, None), (1, 3, 4.0), (None, 1, 2.0), (None, 1, 2.0)],
], ids=["null quantity", "null line", "fractions", "nothing known"])
def test_segment_sums_of_odd_lines(spark, tmp_path, lines):
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalogue.QUERIES["segment_sums"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(c.sql(SQL["segment_sums"]).fetchall(), key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_scan_of_odd_ticks(spark, tmp_path, files):
    """Prices, types, times and numbers that are null, in a file and in a folder of several."""
    at = lambda n: None if n is None else dt.datetime(2024, 1, 1, 0, n)
    ticks = [("a", 0, 1, None), ("a", 1, 2, None), ("a", 2, 3, 5.25), ("a", 3, 4, None), ("a", 3, None, 2.0), ("a", None, 6, 1.5), ("b", 0, 7, 0.0), ("b", 1, 8, None)]
    ticks += [("c", 0, 9, None), (None, 0, 10, None), (None, 1, 11, 3.0), (None, None, 12, -4.0), ("d", 0, 13, None), ("d", 1, 14, -8.5)]
    odd = spark.createDataFrame([(i, at(n), 1, k, v, "{}") for k, n, i, v in ticks], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    odd.repartition(files).write.parquet(str(tmp_path / "parts"))
    found = sorted((tmp_path / "parts").glob("*.parquet"))
    if files == 1:
        found[0].rename(tmp_path / "events.parquet")
    else:
        (tmp_path / "parts").rename(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet{'' if files == 1 else '/*.parquet'}')")
    got = features.QUERIES["stream_scan"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(c.sql(SQL["stream_scan"]).fetchall(), key=str)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Exactly once: a second run with the same folder reads the new files only, and its state holds the earlier rows."""
    from pyspark.sql import functions as F

    from tidemark.streaming.sinks import drained
    from tidemark.streaming.state import stream_cumulative_zscore

    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", i, float(i % 7)) for i in range(40)], "k string, i long, v double")
    stream = lambda: stream_cumulative_zscore(spark.readStream.schema(rows.schema).parquet(source), "k", ["i"], "v")
    rows.where("i < 25").coalesce(1).write.mode("append").parquet(source)
    assert drained(stream(), folder=folder).count() == 25
    rows.where("i >= 25").coalesce(1).write.mode("append").parquet(source)
    got = {r.i: r.z for r in drained(stream(), folder=folder).collect()}
    from tidemark.operators import rolling as R

    want = {r.i: r.z for r in rows.select("i", R.cumulative_zscore(F.col("v"), R.series(["k"], ["i"])).alias("z")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_a_stream_in_slices(spark, tmp_path):
    """A key's rows of a batch go through in slices, shuffled: a worker holds no frame of a whole key."""
    import math

    import numpy as np
    import pandas as pd

    from tidemark.streaming import state as running
    from tidemark.streaming.sinks import drained

    n = 3 * running.SLICE // 2 + 7
    source = str(tmp_path / "in")
    rows = spark.range(n).selectExpr("if(id % 5 = 0, 'b', 'a') k", "id i", "if(id % 11 = 3, null, cast(id * 7919 % 1013 as double)) v")
    rows.orderBy("v", "k").coalesce(1).write.parquet(source)
    seen = drained(running.stream_scan(spark.readStream.schema(rows.schema).parquet(source), "k", ["i"], "v", 0.01)).toPandas().set_index("i").sort_index()
    assert len(seen) == n and seen.h.notna().all()
    for k, own in seen.groupby("k"):
        h, keep, want = 0.0, math.exp(-0.01), []
        for v in own.v.fillna(0.0):
            h = keep * h + v
            want.append(h)
        assert np.allclose(own.h, want)
    places = running.places_in_order([np.array(["b", None, "a", "b"], object), np.array([2.0, 1.0, 5.0, np.nan])])
    assert places.tolist() == [2, 0, 3, 1]

    class Asked:  # gives the function that a worker runs
        dtypes, sparkSession = rows.dtypes, spark
        select = groupBy = lambda self, *columns: self
        applyInPandasWithState = lambda self, update, *rest: update

    class State:
        exists, get = False, None

        def update(self, numbers):
            self.exists, self.get = True, numbers

    parts = [pd.DataFrame({"k": "a", "i": np.arange(n)[::-1], "v": 1.0}) for n in (running.SLICE, running.SLICE)]
    out = list(running.stream_cumulative_zscore(Asked(), "k", ["i"], "v")(("a",), iter(parts), State()))
    assert [len(x) for x in out] == [running.SLICE] * 2 and out[0].i.is_monotonic_increasing


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
