"""Filters of candidate scores, as windows over each sequence's candidates, and the choices made over training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_scores(
    df: DataFrame, keys: list[str], token: str, score: str, seen: str | None = None, penalty: float = 1.0, temperature: float = 1.0,
    top_k: int = 0, top_p: float = 0.0, min_p: float = 0.0,
) -> DataFrame:
    """The rows of df with logit, kept and prob (over the kept candidates, 0 for others).

    In order: candidates that were seen lose by the penalty (divided when positive, multiplied when negative), scores are
    divided by the temperature, top_k keeps the k best (and ties of the last), top_p the best ones that hold this much of
    the mass, min_p those with at least this share of the best one's probability. 0 switches a filter off. Null scores
    are never kept. A key's candidates are bounded by the vocabulary.
    """
    s = F.col(score).cast("double")
    if seen is not None:
        s = F.when(F.col(seen), F.when(s < 0, s * penalty).otherwise(s / penalty)).otherwise(s)
    everyone = Window.partitionBy(*keys)
    rows = df.withColumn("logit", s / temperature)
    kept = F.col("logit").isNotNull()
    if top_k > 0:
        kept &= F.rank().over(everyone.orderBy(F.desc_nulls_last("logit"))) <= top_k
    rows = rows.withColumn("_mass", F.when(kept, F.exp(F.col("logit") - F.max("logit").over(everyone))))
    mass, kept = F.col("_mass"), F.col("_mass").isNotNull()
    if 0 < top_p < 1:
        upward = everyone.orderBy("logit", token).rowsBetween(Window.unboundedPreceding, 0)
        kept &= F.sum(mass).over(upward) / F.sum(mass).over(everyone) > 1 - top_p
    if 0 < min_p < 1:
        kept &= mass >= min_p
    rows = rows.withColumn("kept", F.coalesce(kept, F.lit(False)))
    held = F.when(F.col("kept"), mass)
    return rows.withColumn("prob", F.coalesce(held / F.sum(held).over(everyone), F.lit(0.0))).drop("_mass")


def early_stop(df: DataFrame, keys: list[str], order: str, loss: str, patience: int) -> DataFrame:
    """The rows of df with best (least loss so far), since (rows since it was reached) and stopped (whether patience has run out)."""
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    improved = F.coalesce(F.col(loss) < F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(loss).isNotNull())
    rows = df.withColumns({"_n": F.row_number().over(w), "best": F.min(loss).over(so_far), "_better": improved})
    rows = rows.withColumn("since", (F.col("_n") - F.coalesce(F.max(F.when(F.col("_better"), F.col("_n"))).over(so_far), F.lit(0))).cast("long"))
    return rows.withColumn("stopped", F.max(F.col("since") >= patience).over(so_far)).drop("_n", "_better")


def availability(days: DataFrame, streams: dict[str, DataFrame], key: str) -> DataFrame:
    """The rows of days with a flag for each stream: has it a row of this day? All streams in one aggregation and one join."""
    seen = None
    for name, rows in streams.items():
        part = rows.select(key).distinct().select(key, F.lit(name).alias("_s"))
        seen = part if seen is None else seen.unionByName(part)
    flags = seen.groupBy(key).agg(*[F.max(F.col("_s") == n).alias(n) for n in streams])
    out = days.join(flags, key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in streams})
