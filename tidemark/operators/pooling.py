"""Buckets of vectors pooled by softmax weights, with statistics of what is in them, in one pass over the rows.

The largest score of a bucket is not known ahead, so partial results carry the largest so far with sums scaled to it: two of them
combine by scaling the one with the smaller largest score down. No weight exceeds 1, whatever the scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .ordered import matched

#: Buckets that a task holds before it hands on what it has, and parts that a bucket is combined in first.
HELD, PARTS = 4096, 64


class Partial:
    """Largest score, and sums scaled to it: of weights, and of weighted vectors."""

    __slots__ = ("most", "weight", "vector")

    def __init__(self, most: float, weight: float, vector: np.ndarray):
        self.most, self.weight, self.vector = most, weight, vector

    def add(self, most: float, weight: float, vector: np.ndarray) -> None:
        if most > self.most:
            scale = np.exp(self.most - most)
            self.most, self.weight, self.vector = most, self.weight * scale + weight, self.vector * scale + vector
        else:
            scale = np.exp(most - self.most)
            self.weight += weight * scale
            self.vector = self.vector + vector * scale


def _rows(table, keys: list[str]):
    """(key, most, weight, vector) of each row of a table of partial results."""
    columns = [table.column(k).to_pylist() for k in keys]
    vectors = table.column("_vector").to_pylist()
    return zip(zip(*columns, strict=True), table.column("_most").to_pylist(), table.column("_weight").to_pylist(), vectors, strict=True)


def _table(found: dict, schema):
    import pyarrow as pa

    keys = [list(c) for c in zip(*found, strict=True)]
    values = list(found.values())
    data = [*keys, [p.most for p in values], [p.weight for p in values], [p.vector.tolist() for p in values]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, schema, strict=True)], schema=schema)


def softmax_vectors(df: DataFrame, keys: list[str], vector: str, score: str) -> DataFrame:
    """A row for each bucket: keys and `pooled`, the mean vector by softmax of the scores. Rows without a score or a vector don't count.

    Tasks put their rows together by bucket before any shuffle; then a bucket meets in up to 64 parts and these in one. Vectors of
    a bucket have one length.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    state = f"{head}_most double, _weight double, _vector array<double>"
    rows = df.where(F.col(vector).isNotNull() & F.col(score).isNotNull())
    rows = rows.select(*keys, F.col(score).cast("double").alias("_most"), F.lit(1.0).alias("_weight"), F.col(vector).cast("array<double>").alias("_vector"))

    def together(batches):
        found, schema = {}, None
        for batch in batches:
            schema = batch.schema
            for key, most, weight, v in _rows(batch, keys):
                v = np.array(v, float)
                if key in found:
                    found[key].add(most, weight, v)
                else:
                    found[key] = Partial(most, weight, v)
            if len(found) > HELD:
                yield _table(found, schema)
                found = {}
        if found:
            yield _table(found, schema)

    def combine(table):
        import pyarrow as pa

        dropped = table.select([*keys, "_most", "_weight", "_vector"])
        return pa.Table.from_batches(together(dropped.combine_chunks().to_batches()))

    parts = rows.mapInArrow(together, state).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = parts.groupBy(*keys, "_part").applyInArrow(combine, state)
    whole = some.groupBy(*keys).applyInArrow(combine, state)
    return whole.select(*keys, F.transform("_vector", lambda x: x / F.col("_weight")).alias("pooled"))


def pooled_buckets(rows: DataFrame, buckets: DataFrame, keys: list[str], vector: str, score: str, statistics: dict[str, Column], width: int) -> DataFrame:
    """A row for each row of `buckets` (keys): n, pooled, and the statistics (name: aggregate) of its rows; zeros where it has none.

    width: of the vector of zeros.
    """
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[a.alias(n) for n, a in statistics.items()])
    found = matched(facts, softmax_vectors(rows, keys, vector, score), keys)
    on = buckets.select(*keys).distinct()
    named = found.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & on[k].eqNullSafe(named[f"_on_{k}"])
    out = on.join(named, test, "left")
    zeros = F.array_repeat(F.lit(0.0), width)
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pooled", zeros).alias("pooled"), *[F.coalesce(s, F.lit(0)).alias(s) for s in statistics])
