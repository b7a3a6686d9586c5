"""Economic series over REST as a Spark data source: one partition a series, read by the executors.

    spark.dataSource.register(SeriesSource)
    rows = spark.read.format("econ_series").option("series", "DGS10,DFF").option("api_key", key).load()

Rows are (series, date, value); the service's `.` is null. `base` may be a folder of files `<series>.json` in place of the
service's address, or of folders `series=<name>` with an observation a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from ..functions.shipping import ship

SERVICE = "https://api.stlouisfed.org/fred/series/observations"


class OneSeries(InputPartition):
    def __init__(self, name: str):
        self.name = name


class SeriesReader(DataSourceReader):
    def __init__(self, options):
        self.names = [s.strip() for s in options.get("series", "").split(",") if s.strip()]
        if not self.names:
            raise ValueError("option 'series' names no series")
        self.base, self.key = options.get("base", SERVICE), options.get("api_key", "")
        self.first, self.last = options.get("first", ""), options.get("last", "")
        self.tries, self.wait = int(options.get("tries", "3")), float(options.get("wait", "2"))

    def partitions(self):
        return [OneSeries(n) for n in self.names]

    def read(self, partition):
        import datetime as dt

        for o in self._observations(partition.name):
            if (not self.first or o["date"] >= self.first) and (not self.last or o["date"] <= self.last):
                try:
                    value = float(o["value"])
                except (TypeError, ValueError):
                    value = None
                yield partition.name, dt.date.fromisoformat(o["date"]), value

    def _observations(self, name: str):
        """The answer's observations, or the lines of the files in a folder `series=<name>`, one each."""
        import json
        from pathlib import Path

        folder = Path(self.base.removeprefix("file://")) / f"series={name}"
        if not self.base.startswith("http") and folder.is_dir():
            for path in sorted(folder.glob("part-*")):
                with path.open(encoding="utf-8") as lines:
                    yield from map(json.loads, lines)
        else:
            yield from json.loads(self._fetch(name)).get("observations", [])

    def _fetch(self, name: str) -> str:
        import time
        from pathlib import Path
        from urllib.error import URLError
        from urllib.parse import urlencode
        from urllib.request import urlopen

        if "://" not in self.base:
            return (Path(self.base) / f"{name}.json").read_text()
        asked = {"series_id": name, "api_key": self.key, "file_type": "json", "observation_start": self.first, "observation_end": self.last}
        url = f"{self.base}?{urlencode({k: v for k, v in asked.items() if v})}"
        for left in reversed(range(self.tries)):
            try:
                with urlopen(url, timeout=30) as answer:
                    return answer.read().decode()
            except URLError:
                if not left:
                    raise
                time.sleep(self.wait)
        raise ValueError("option 'tries' must be positive")


class BoundedReader(SeriesReader):
    """Takes over what a query asks of the date."""

    def pushFilters(self, filters):
        """Inclusive bounds on the date reach the request; every filter is left to Spark as well."""
        for f in filters:
            if f.attribute == ("date",) and isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, str(f.value))
            elif f.attribute == ("date",) and isinstance(f, LessThanOrEqual):
                self.last = min(self.last or str(f.value), str(f.value))
            yield f


class SeriesSource(DataSource):
    @classmethod
    def name(cls):
        return "econ_series"

    def schema(self):
        return "series string, date date, value double"

    def reader(self, schema):
        return (BoundedReader if self.options.get("pushdown") == "true" else SeriesReader)(self.options)


def observations(spark: SparkSession, names: list[str], **options: str) -> DataFrame:
    """The rows of these series, with options as above; bounds on the date that a query sets are asked of the service."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)
    return spark.read.format("econ_series").options(series=",".join(names), pushdown="true", **options).load()


def as_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row a date with a column a series, null where it has none: an outer join of all series in one aggregation."""
    return rows.groupBy("date").pivot("series", names).agg(F.first("value", ignorenulls=True))
