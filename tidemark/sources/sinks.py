"""Writers: a folder a day with resumption, appended CSV, rewritten tables, and the row index of a materialised feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.sinks import shared_folder
from .files import optional_parquet


def write_days(df: DataFrame, path: str, date_col: str = "date", redo: bool = False) -> None:
    """One folder a day. Days that exist stay as they are and are left out before the exchange; with redo they are replaced.

    Rows of a day go to one file, unless the day is large: then adaptive execution splits it.
    """
    if not redo and (there := optional_parquet(df.sparkSession, [path])) is not None:
        df = df.join(there.select(F.col(date_col).cast(dict(df.dtypes)[date_col]).alias(date_col)).distinct(), date_col, "left_anti")
    spread = df.hint("rebalance", F.col(date_col))
    spread.write.mode("overwrite" if redo else "append").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(date_col).parquet(path)


def write_one(df: DataFrame, path: str) -> None:
    """A single Parquet file, for small results: the last step runs in one task."""
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_csv(df: DataFrame, path: str, anew: bool = False) -> None:
    """Adds rows to a folder of CSV files that each have a header; anew replaces it."""
    df.write.mode("overwrite" if anew else "append").csv(path, header=True)


def write_statistics(df: DataFrame, path: str) -> None:
    """A table of statistics as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def rewritten(df: DataFrame, changes: dict[str, Column], path: str) -> DataFrame:
    """df with changed columns at a new path, read back. Readers move over when it is whole; the old table isn't touched."""
    df.withColumns(changes).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def switched(spark: SparkSession, view: str, path: str) -> DataFrame:
    """Lets a view show the table at path from now on: readers by the view's name move over in one step, running ones end on the old files."""
    spark.read.parquet(path).createOrReplaceTempView(view)
    return spark.table(view)


def published(df: DataFrame, changes: dict[str, Column], root: str) -> str:
    """df with changed columns as the next version of the table at root, for every session; returns the version's path.

    A version is whole before a note with its number is added to the folder `_versions`, in one step; readers take the highest note
    (`current`), running ones end on their files. Two writers at once get different versions; the later note counts.
    """
    import uuid

    spark, path = df.sparkSession, f"{root}/data-{uuid.uuid4().hex}"
    df.withColumns(changes).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    last = _versions(spark, root).agg(F.max("version")).first()[0] or 0
    note = spark.range(1).select((F.col("id") + last + 1).alias("version"), F.lit(path.rsplit("/", 1)[1]).alias("data"))
    note.coalesce(1).write.mode("append").json(f"{root}/_versions/notes")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table at root in its latest version; an error where there is none."""
    newest = _versions(spark, root).agg(F.max_by("data", F.struct("version", "data"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no version of a table at {root}")
    return spark.read.parquet(f"{root}/{newest}")


def _versions(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    kinds = "version long, data string"
    try:
        return spark.read.schema(kinds).json(f"{root}/_versions/notes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: made once, safe from lost executors, and the end of their lineage."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def day_index(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Per day the number of its rows and of all rows before: where its slice starts in rows ordered by day."""
    counts = df.groupBy(date_col).agg(F.count("*").alias("length"))
    before = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    return counts.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
