"""Mixing sources to target weights: exact word quotas, a multivariate-hypergeometric splitting tree over output shards,
disjoint permuted blocks, and a local shuffle.

Each source's target is its share of all words, at most `most` times its own words; the excess goes to the others by weight.
A source gives every document floor(target / words) times, and for the rest a permuted run of blocks and, in the last block,
of documents; the last document drawn gives a part, so that a source's words equal its target, rounded. One row a source
comes to the driver, at most `most_sources` of them (else an error); documents never do.

Null text: no words, drawn never. Null source: a source of its own, last in order. Rows that repeat a doc_id are drawn apart;
rows alike in id and text lie in one block, unless they are too many for one: then they are numbered and dealt by number.
An empty table gives an empty result. Columns of df, whatever their names, come back in the struct `kept` where asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.long_series import numbered
from .common import WORD, written


CELL = 4096  # blocks that lie together in a source's permuted order


def targets(sizes: list[int], weights: list[float], most: float = 3) -> list[float]:
    """Shares of all words by weight; what a source can't take (most times its words) is shared again by weight."""
    total, held = float(sum(sizes)), {}
    while True:
        left, weight = total - sum(held.values()), sum(w for i, w in enumerate(weights) if i not in held)
        want = [held[i] if i in held else left * w / weight if weight else 0.0 for i, w in enumerate(weights)]
        if not (over := [i for i in range(len(sizes)) if i not in held and want[i] > most * sizes[i]]):
            return want
        held |= {i: float(most * sizes[i]) for i in over}


def split_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[s] draws of each source dealt to shards of near-equal size: halves are drawn without replacement, again and again."""
    out = np.zeros((shards, len(counts)), np.int64)

    def deal(left: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = left
            return
        middle = (low + high) // 2
        take = int(left.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        half, rest, need = np.zeros_like(left), int(left.sum()), take
        for s, n in enumerate(left):  # marginals of the multivariate law, source by source
            rest -= int(n)
            half[s] = _hypergeometric(rng, int(n), rest, need)
            need -= int(half[s])
        deal(half, low, middle)
        deal(left - half, middle, high)

    deal(np.asarray(counts, np.int64), 0, shards)
    return out


def _hypergeometric(rng, good: int, bad: int, take: int) -> int:
    """How many of `take` draws without replacement are good.

    Beyond numpy's range the same law is drawn in exact pieces: each item is in with chance take / total, which makes a
    random set of about the right size; what it has too many is drawn out of it, what it lacks out of the rest.
    """
    if not take or not good or not bad:
        return min(good, take)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    if take <= 1000:
        found = 0
        for n in range(take):
            found += int(rng.integers(good + bad - n)) < good - found
        return found
    share = take / (good + bad)
    x, y = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    if x + y > take:
        return x - _hypergeometric(rng, x, y, x + y - take)
    return x + _hypergeometric(rng, good - x, bad - y, take - x - y)


def _numbered(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """rows with a number, from 0, for those of the groups in alike (source, doc_id, alike), so that a group's numbers are the same in every run."""
    keys = ["source", "doc_id", "alike"]
    groups = alike.select(*keys, F.lit(True).alias("many"))
    at = F.monotonically_increasing_id()
    told = written(matched_left(rows.drop("number"), groups, keys).withColumn("at", at))
    many = numbered(told.where("many").withColumn("cell", F.shiftright("at", 12)), keys, "cell", ["at"], "nth").withColumn("number", F.col("nth") - 1)
    return told.where("many IS NULL").withColumn("number", F.lit(0).cast("long")).unionByName(many.drop("cell", "nth")).drop("at", "many")


def matched_left(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which null matches null. groups: one for every few hundred rows at most."""
    named = groups.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return rows.join(named, test, "left").drop(*[f"_on_{k}" for k in keys])


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3, shards: int = 16, block_rows: int = 256, seed: int = 17, keep: tuple[str, ...] = (), most_sources: int = 100_000,
) -> DataFrame:
    """Rows: doc_id, source, size, source_size, target, taken, block, draws (array of (epoch, shard, place, words)), and kept, a struct of the columns in keep.

    draws lists where the document's copies go: place orders a shard's documents within a block after the local shuffle.
    """
    spark = df.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    inner = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("alike")]
    inner.append(F.lit(0).cast("long").alias("number"))
    rows = df.select(*inner, *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []))
    narrow = written(df.select(*inner))  # ids and sizes; the texts are read no more
    alike = narrow.groupBy("source", "doc_id", "alike").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    if not alike.isEmpty():  # too many for a block of rows that nothing tells apart: they are numbered and dealt by number
        rows = written(_numbered(rows, alike))
        narrow = rows.drop("kept")
    rows = rows if keep else narrow
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(most_sources + 1).collect()  # a row for each source
    if len(by_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them, or raise most_sources")
    by_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r.words for r in by_source]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    plan = []
    for i, (r, t) in enumerate(zip(by_source, want, strict=True)):
        goal = min(round(t), most * r.words)
        whole = goal // r.words if r.words else 0
        plan.append((i, r.source, r.words, t, whole, goal - whole * r.words, max(1, -(-r.n // block_rows))))
    facts = spark.createDataFrame(plan, "s int, source string, source_size long, target double, whole long, rest long, blocks long")

    def key(*parts):  # a keyed permutation
        return F.xxhash64(F.lit(seed), *parts)

    rows = rows.join(F.broadcast(facts.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")  # bounded by the number of sources
    block = [F.col("doc_id"), F.col("alike"), F.lit("block")]
    block = F.pmod(F.when(F.col("number") == 0, key(*block)).otherwise(key(*block, F.col("number"))), F.col("blocks"))
    rows = rows.withColumn("block", block)
    in_block = Window.partitionBy("s", "block").orderBy(key(F.col("doc_id"), F.lit("place")), "doc_id", "size", "alike", "number")
    rows = rows.withColumns({"place": F.row_number().over(in_block), "before": F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    # Blocks in permuted order; those within the rest are drawn once more, the last in part.
    blocks = narrow.join(F.broadcast(facts.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    blocks = blocks.groupBy("s", block.alias("block")).agg(F.sum("size").alias("block_words"))
    # Permuted order is that of `turn`; a source's blocks lie in cells of some thousand, whose sums are added up first, so that no task has a source whole.
    turn = key(F.col("s"), F.col("block"))
    cell = F.floor((turn / F.lit(2.0**64) + 0.5) * (F.floor(F.col("of") / CELL) + 1))
    blocks = written(blocks.join(F.broadcast(facts.select("s", F.col("blocks").alias("of"))), "s").withColumn("cell", cell).drop("of"))
    cells = blocks.groupBy("s", "cell").agg(F.sum("block_words").alias("words"), F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "cell", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("words", "n")])
    order = Window.partitionBy("s", "cell").orderBy(turn, "block")
    here = {"nth": F.row_number().over(order), "start": F.sum("block_words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_words")}
    blocks = blocks.withColumns(here).join(cells, ["s", "cell"])
    blocks = written(blocks.select("s", "block", "block_words", (F.col("nth") + F.col("n_before")).alias("nth"), (F.col("start") + F.col("words_before")).alias("start")))
    drawn = blocks.join(F.broadcast(facts.select("s", "whole", "rest")), "s").groupBy("s")
    drawn = drawn.agg(F.first("whole").alias("whole"), F.count("*").alias("n"), F.count_if(F.col("start") < F.col("rest")).alias("part"))
    counts = {r.s: (r.whole * r.n + r.part, r.n) for r in drawn.collect()}
    dealt = split_tree([counts.get(i, (0, 0))[0] for i in range(len(plan))], shards, seed)
    ends = spark.createDataFrame([(i, [int(x) for x in np.cumsum(np.roll(dealt[:, i], -i))]) for i in range(len(plan))], "s int, ends array<long>")
    # The j-th draw of a source (epoch by epoch, blocks in permuted order) goes to the first shard, counted from the s-th, whose quota reaches past j.
    n_blocks = spark.createDataFrame([(i, counts.get(i, (0, 0))[1]) for i in range(len(plan))], "s int, n_blocks long")
    rows = rows.join(blocks, ["s", "block"]).join(F.broadcast(ends), "s").join(F.broadcast(n_blocks), "s")
    part = F.least(F.greatest(F.col("rest") - F.col("start") - F.col("before"), F.lit(0)), F.col("size"))

    def draw(epoch, words):
        j = epoch * F.col("n_blocks") + F.col("nth") - 1
        shard = F.pmod(F.size(F.filter("ends", lambda e: e <= j)) + F.col("s"), F.lit(shards))
        return F.struct(epoch.alias("epoch"), shard.alias("shard"), key(F.col("doc_id"), F.col("nth"), epoch).alias("place"), words.alias("words"))

    words = lambda e: F.when(e < F.col("whole"), F.col("size")).when(e == F.col("whole"), part).otherwise(F.lit(0))
    whole = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: draw(e.cast("long"), words(e))))
    rows = rows.withColumn("draws", F.coalesce(F.filter(whole, lambda d: d.words > 0), F.array().cast("array<struct<epoch:bigint,shard:int,place:bigint,words:bigint>>")))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.words)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "block", "draws", *(["kept"] if keep else []))
