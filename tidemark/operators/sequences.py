"""Sequence operators: segments, causal convolution, pooling of vectors, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .long_series import scan as selective_scan  # noqa: F401
from .long_series import states_before


def segments(w: WindowSpec, size: int):
    """Number of the run of `size` rows that a row lies in."""
    return F.floor((F.row_number().over(w) - 1) / size).cast("long")


def causal_conv(x: str, weights: list[float], w: WindowSpec, before: list[float] | None = None):
    """Sum of weights[k] * the value k rows before. Before the start come the values of `before`, the last of them nearest, then 0."""
    known = F.array(*[F.lit(float(v)) for v in [0.0] * len(weights) + list(before or [])])
    at = F.row_number().over(w) - 1

    def back(k: int):
        return F.when(at >= k, F.coalesce(F.lag(x, k).over(w), F.lit(0.0))).otherwise(F.try_element_at(known, at - k)) if k else F.coalesce(F.col(x), F.lit(0.0))

    return sum((F.lit(c) * back(k) for k, c in enumerate(weights)), F.lit(0.0))


def segment_sums(df: DataFrame, keys: list[str], order: list, x: str, out: str) -> DataFrame:
    """For each row of a segment the sums of x from after each earlier row up to this one, then 0: a row of the lower
    triangle, by differences of running sums. keys name a segment of bounded length.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", F.sum(x).over(w))
    return rows.withColumn(out, F.transform(F.collect_list("_s").over(w), lambda s: F.col("_s") - s)).drop("_s")


def chunk_sums(df: DataFrame, keys: list[str], cell: str, x: str, decay: str, out: str) -> DataFrame:
    """One row a chunk: keys, cell, and the state that it starts from, where state = exp(sum of decay) * state + sum of x, chunk by chunk.

    cell: a whole number or a date. Null x and decay count as 0.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    parts = df.groupBy(*keys, cell).agg(F.array(F.exp(total(decay))).alias("_a"), F.array(total(x)).alias("_b"))
    return states_before(parts, keys, cell, "_a", "_b").select(*keys, cell, F.col("state")[0].alias(out))


def softmax_pool(df: DataFrame, keys: list[str], vector: str, score: str) -> DataFrame:
    """Per key the mean vector weighted by exp(score), position by position: partial sums, no vector lists."""
    w = F.exp(F.col(score))
    parts = df.select(*keys, w.alias("_w"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "_v"))
    return parts.groupBy(*keys, "pos").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("pooled"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which side."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def keep_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")
