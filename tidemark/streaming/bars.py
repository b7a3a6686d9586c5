"""Bars from a stream of ticks: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_ticks(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_bars(ticks: DataFrame, every: str, late: str) -> DataFrame:
    order = F.struct("ts", "tick_id")
    grouped = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", every))
    out = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trade_count"))
    return out.select("ticker", F.col("window.start").alias("bar"), "open", "high", "low", "close", "volume", "trade_count")


def sliding(ticks: DataFrame, length: str, every: str, late: str) -> DataFrame:
    """Count and highest price of windows that overlap."""
    grouped = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", length, every))
    return grouped.agg(F.count("*").alias("n"), F.max("price").alias("high")).select("ticker", F.col("window.start").alias("bar"), "n", "high")


def sessions(ticks: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of ticks less than `gap` apart, each given out once the watermark has passed its end."""
    grouped = ticks.withWatermark("ts", late).groupBy("ticker", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
