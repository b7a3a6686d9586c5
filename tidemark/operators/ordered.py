"""Row order along long series in two levels: windows run within cells of a series, and one row a cell carries over.

A cell is a column that never falls along the order (a day, a range of ids), so cells follow each other as their rows do.
Few series of many rows then make many small windows, and the windows over a whole series see one row a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the keys, of which null matches null; the keys of df stay."""
    named = other.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & df[k].eqNullSafe(named[f"_on_{k}"])
    return df.join(named, test).drop(*[f"_on_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """df with the row's number in its series, from 1."""
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, cell).agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    return matched(df.withColumn("_nth", nth), starts, [*keys, cell]).withColumn(name, F.col("_start") + F.col("_nth")).drop("_nth", "_start")


def lagged(df: DataFrame, keys: list[str], cell: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before in its series."""
    ends = df.groupBy(*keys, cell).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    ends = ends.select(*keys, cell, F.lag("_end").over(Window.partitionBy(*keys).orderBy(cell)).alias("_end"))
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    here = F.lag(F.struct(value)).over(w)
    return matched(df.withColumn("_here", here), ends, [*keys, cell]).withColumn(name, F.coalesce("_here", "_end")[value]).drop("_here", "_end")


def cut(df: DataFrame, keys: list[str], cell: str, order: list[str], size: int, name: str) -> DataFrame:
    """df with the number, from 0, of the run of `size` rows that a row lies in."""
    rows = numbered(df, keys, cell, order, "_row")
    return rows.withColumn(name, F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row")
