"""Sources and sinks on small files made by each test."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import files, filings, series, sinks


def test_daily_parquet_by_name(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "notes"):
        spark.createDataFrame([(day,)], "x string").toPandas().to_parquet(tmp_path / f"{day}.parquet")
    (tmp_path / "._2024-01-02.parquet").write_text("no table")
    got = files.daily_parquet(spark, str(tmp_path), "2024-01-02", "2024-01-03")
    assert sorted((r.x, str(r.date)) for r in got.collect()) == [("2024-01-02", "2024-01-02"), ("2024-01-03", "2024-01-03")]
    assert sorted(r.x for r in files.daily_parquet(spark, str(tmp_path)).where("date is null").collect()) == ["notes"]


def test_daily_parquet_by_folders(spark, tmp_path):
    for day in ("2024/01/01", "2024/02/01"):
        (tmp_path / day).mkdir(parents=True)
        spark.createDataFrame([(day,)], "x string").toPandas().to_parquet(tmp_path / day / "part.parquet")
    got = files.daily_parquet(spark, str(tmp_path), first="2024-01-15", nested=True)
    assert [(r.x, str(r.date)) for r in got.collect()] == [("2024/02/01", "2024-02-01")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,close,note\n2024-01-01,1.5,x\n2024-01-02,oops\n2024-01-03,2,y,z\n")
    want = {"close": "double", "day": "date"}
    kept = {str(r.day): r.close for r in files.csv_columns(spark, str(tmp_path / "a.csv"), want, skip_long_lines=True).collect()}
    assert kept == {"2024-01-01": 1.5, "2024-01-02": None}
    assert files.csv_columns(spark, str(tmp_path / "a.csv"), want).count() == 3
    (tmp_path / "b.csv").write_text("1,a\n2,b\n")
    assert [tuple(r) for r in files.csv_headerless(spark, str(tmp_path / "b.csv"), "i int, s string").orderBy("i").collect()] == [(1, "a"), (2, "b")]


def test_lists_ranges_and_candidates(spark, tmp_path):
    (tmp_path / "list.txt").write_text("SPY\n\n QQQ \n")
    x = spark.createDataFrame([("SPY",), ("IWM",), ("QQQ",), (None,)], "ticker string")
    assert sorted(r.ticker for r in files.in_list(x, "ticker", str(tmp_path / "list.txt")).collect()) == ["QQQ", "SPY"]
    day = 86_400_000_000_000
    n = spark.createDataFrame([(day - 1,), (day,), (2 * day - 1,), (2 * day,)], "ns bigint")
    assert files.time_range(n, "ns", "1970-01-02", "1970-01-02").count() == 2
    x.write.parquet(str(tmp_path / "there"))
    found = files.optional_parquet(spark, [str(tmp_path / "missing"), str(tmp_path / "there")], ["ticker", "other"])
    assert found.columns == ["ticker"] and files.optional_parquet(spark, [str(tmp_path / "missing")]) is None


def test_listing(spark, tmp_path):
    for name, text in {"runs/b/x.txt": "12", "runs/a/y.txt": "1", "runs/top.txt": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.listing(spark, str(tmp_path))
    assert {r["key"]: r["size"] for r in found.collect()} == {"runs/b/x.txt": 2, "runs/a/y.txt": 1, "runs/top.txt": 1}
    assert [r.run_id for r in files.run_ids(found, "runs/").collect()] == ["b", "a"]
    assert files.with_prefix(found, ["runs/a", "runs/b"]).count() == 2
    stored = found.withColumn("size", F.when(F.col("key") == "runs/b/x.txt", F.lit(9)).otherwise(F.col("size")))
    assert [r["key"] for r in files.to_send(found, stored).collect()] == ["runs/b/x.txt"]
    names = spark.createDataFrame([("2019/x",), ("2021-01-01.parquet",), ("plain",)], "key string")
    assert files.of_years(names, 2020, 2022).count() == 2 and files.of_years(names, 2020, 2022, keep_unknown=False).count() == 1


def test_company_facts(spark, tmp_path):
    units = {"shares": [{"val": 1, "filed": "2024-01-01"}], "USD": [{"val": 5, "filed": "2024-02-01", "end": "2023-12-31"}, {"val": None, "filed": "2024-02-01"}, {"val": 7}]}
    doc = {"cik": 12, "entityName": "A", "facts": {"us-gaap": {"Revenues": {"units": units}, "Odd": {"units": {"mile": [{"val": 1, "filed": "2024-01-01"}]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    docs = filings.documents(spark, str(tmp_path))
    got = filings.facts(docs, {"revenue": ["Revenues", "Sales"]}).collect()
    assert [(r.cik, r.tag, r.metric, r.unit, r.value, r.filed) for r in got] == [(12, "Revenues", "revenue", "USD", 5.0, dt.date(2024, 2, 1))]
    assert filings.facts(docs).count() == 1
    about = spark.createDataFrame([(json.dumps({"cik": "0000012", "name": "A", "sic": "3571", "tickers": ["X", "Y"]}),), (json.dumps({"cik": "13", "tickers": []}),)], "value string")
    assert sorted((r.cik, r.sic, r.ticker) for r in filings.submissions(about).collect()) == [(12, 3571, "X"), (13, None, None)]


def test_series_source(spark, tmp_path):
    for name, values in {"A": [("2024-01-01", "1.5"), ("2024-01-02", ".")], "B": [("2024-01-02", "3")]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"observations": [{"date": d, "value": v} for d, v in values]}))
    spark.dataSource.register(series.SeriesSource)
    rows = spark.read.format("econ_series").option("series", "A,B").option("base", str(tmp_path)).load()
    assert sorted((r.series, str(r.date), r.value) for r in rows.where("value is not null").collect()) == [("A", "2024-01-01", 1.5), ("B", "2024-01-02", 3.0)]
    assert sorted((str(r.date), r.A, r.B) for r in series.as_columns(rows, ["A", "B"]).collect()) == [("2024-01-01", 1.5, None), ("2024-01-02", None, 3.0)]


def test_days_resume(spark, tmp_path):
    path = str(tmp_path / "days")

    def rows(*days, x):
        return spark.createDataFrame([(dt.date(2024, 1, d), x) for d in days], "date date, x int")

    sinks.write_days(rows(1, 2, x=1), path)
    sinks.write_days(rows(2, 3, x=2), path)
    assert sorted((r.date.day, r.x) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 1), (3, 2)]
    sinks.write_days(rows(2, x=9), path, redo=True)
    assert sorted((r.date.day, r.x) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 9), (3, 2)]


def test_other_sinks(spark, tmp_path):
    x = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0), (dt.date(2024, 1, 1), 2.0), (dt.date(2024, 1, 2), 3.0)], "date date, v double")
    assert sorted((r.date.day, r.length, r.offset) for r in sinks.day_index(x).collect()) == [(1, 1, 0), (2, 2, 1)]
    sinks.append_csv(x, str(tmp_path / "csv"))
    sinks.append_csv(x, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6
    sinks.write_one(x, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert sinks.rewritten(x, {"v": F.col("v") * 2}, str(tmp_path / "new")).agg(F.sum("v")).first()[0] == 12.0
    sinks.write_statistics(x.agg(F.avg("v").alias("mean")), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first()["mean"] == 2.0


def test_versions_of_a_table(spark, tmp_path):
    import pytest

    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, root)
    x = spark.createDataFrame([(1, 2.0), (2, None)], "i int, v double")
    sinks.published(x, {}, root)
    before = sinks.current(spark, root)
    sinks.published(before, {"v": F.col("v") * 1000}, root)
    assert sorted(map(str, before.collect())) == sorted(map(str, x.collect()))  # a reader ends on what it began with
    assert {r.i: r.v for r in sinks.current(spark.newSession(), root).collect()} == {1: 2000.0, 2: None}


def test_bounds_on_the_date_reach_the_service(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"observations": [{"date": f"2024-01-0{i}", "value": "." if i == 3 else str(i)} for i in range(1, 8)]}))
    rows = series.observations(spark, ["A", "B"], base=str(tmp_path)).where("date >= date'2024-01-03' and date <= date'2024-01-05'")
    assert sorted((r.series, r.date.day, r.value) for r in rows.collect() if r.value) == [("A", 4, 4.0), ("A", 5, 5.0), ("B", 4, 4.0), ("B", 5, 5.0)]
    assert rows.count() == 6 and rows.rdd.getNumPartitions() == 2
    reader = series.BoundedReader({"series": "A", "first": "2024-01-02"})
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    left = list(reader.pushFilters([GreaterThanOrEqual(("date",), dt.date(2024, 1, 4)), LessThanOrEqual(("date",), dt.date(2024, 1, 6)), LessThanOrEqual(("value",), 3.0)]))
    assert (reader.first, reader.last, len(left)) == ("2024-01-04", "2024-01-06", 3)
