"""Readers of files: daily Parquet, CSV by column name, line lists, optional sources, listings of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def day_of_name(path: Column) -> Column:
    """The day that a file's name starts with (`2024-01-05.parquet`), or null."""
    return F.regexp_extract(path, r"/?(\d{4}-\d{2}-\d{2})[^/]*$", 1).try_cast("date")


def day_of_folders(path: Column) -> Column:
    """The day that a file's folders give (`2024/01/05/x.parquet`, `date=2024-01-05/x.parquet`), or null."""
    folders = F.regexp_extract(path, r"/(?:\w+=)?(\d{4}[/-]\d{2}[/-]\d{2})/[^/]*$", 1)
    return F.replace(folders, F.lit("/"), F.lit("-")).try_cast("date")


def daily_parquet(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None, date_col: str = "date", nested: bool = False) -> DataFrame:
    """Files of one day each, whose day stands in their path alone; date_col replaces a column of that name.

    Bounds are inclusive, and with a bound files without a readable day are left out. The filter is on the file's path, so
    that Spark drops files before reading them. Hidden files (`._x`, `_x`) are never read.
    """
    rows = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", nested).parquet(folder)
    day = (day_of_folders if nested else day_of_name)(F.col("_metadata.file_path"))
    for bound, test in ((first, day >= F.lit(first).cast("date")), (last, day <= F.lit(last).cast("date"))):
        rows = rows.where(test) if bound else rows
    return rows.withColumn(date_col, day)


def csv_columns(spark: SparkSession, path: str | list[str], columns: dict[str, str], skip_long_lines: bool = False) -> DataFrame:
    """The named columns of CSV files with a header, cast to the given types (null where a value doesn't fit).

    Lines with fewer fields than the header end in nulls. Lines with more are cut to the header's fields, or left out with
    skip_long_lines.
    """
    names = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, "_over"])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    rows = rows.where("_over is null") if skip_long_lines else rows
    return rows.select(*[F.trim(F.col(f"`{c}`")).try_cast(kind).alias(c) for c, kind in columns.items()])


def csv_headerless(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=False)


def in_list(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows of df whose value stands on a line of the file at path; blank lines don't count."""
    lines = df.sparkSession.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "").distinct()
    return df.join(lines, column, "left_semi")


def time_range(df: DataFrame, nanos: str, first: str, last: str) -> DataFrame:
    """Rows from the first day to the last, both whole: a half-open range on the stored number, which Parquet filters."""
    def ns(day: str, plus: int) -> Column:
        return F.lit((_days(day) + plus) * 86_400_000_000_000)

    return df.where((F.col(nanos) >= ns(first, 0)) & (F.col(nanos) < ns(last, 1)))


def _days(day: str) -> int:
    import datetime as dt

    return (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days


def optional_parquet(spark: SparkSession, candidates: list[str], columns: list[str] | None = None) -> DataFrame | None:
    """The first candidate that exists, with those of the columns that it has; None without one."""
    from pyspark.errors import AnalysisException

    for path in candidates:
        try:
            rows = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return rows.select(*[c for c in columns if c in rows.columns]) if columns else rows
    return None


def optional_sources(spark: SparkSession, sources: dict[str, tuple[list[str], list[str]]]) -> dict[str, DataFrame]:
    """By name those of the sources (candidate paths, wanted columns) that exist, each with the columns that it has."""
    found = {name: optional_parquet(spark, paths, columns) for name, (paths, columns) in sources.items()}
    return {name: rows for name, rows in found.items() if rows is not None}


def concatenated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one kind under each other; a column that a file lacks is null there."""
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def of_patterns(df: DataFrame, patterns: list[str], path: str = "key") -> DataFrame:
    """Rows whose file name fits one of the patterns, * for anything: `2024-*`."""
    name, test = F.substring_index(F.col(path), "/", -1), F.lit(False)
    for p in patterns:
        test |= name.like(p.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
    return df.where(test)


def index_or_listing(index: DataFrame, listed: DataFrame, indexed_at: str, now: str, days: int = 15) -> DataFrame:
    """The stored index while it is no older than `days`, else what a new listing found."""
    age = _days(now) - _days(indexed_at)
    return index if 0 <= age <= days else listed


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """key (the path below root), size and modified of every file under root; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    key = F.substring_index(F.col("path"), base, -1)
    return files.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def of_years(df: DataFrame, first: int, last: int, path: str = "key", keep_unknown: bool = True) -> DataFrame:
    """Rows whose path is of the years; paths without a year stay unless keep_unknown is off."""
    return df.where(F.coalesce(S.path_year(F.col(path)).between(first, last), F.lit(keep_unknown)))


def run_ids(keys: DataFrame, prefix: str, path: str = "key") -> DataFrame:
    """The distinct first parts of the paths below prefix, newest name first."""
    below = F.when(F.col(path).startswith(prefix), F.substr(F.col(path), F.lit(len(prefix) + 1)))
    ids = keys.select(F.regexp_extract(below, r"^([^/]+)/", 1).alias("run_id")).where("run_id != ''")
    return ids.distinct().orderBy(F.desc("run_id"))


def with_prefix(keys: DataFrame, prefixes: list[str], path: str = "key") -> DataFrame:
    test = F.lit(False)
    for p in prefixes:
        test |= F.col(path).startswith(p)
    return keys.where(test)


def to_send(local: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of local that the store lacks or holds with another size."""
    return local.join(stored.select("key", "size").distinct(), ["key", "size"], "left_anti")
