"""Helpers that the operators of this package share: tables, scratch space, byte-level words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.shipping import ship  # noqa: F401

#: The word separators of every operator here: space, tab, LF, VT, FF, CR (one byte each in UTF-8).
SPACES = b" \t\n\x0b\x0c\r"
#: As a regular expression of Spark SQL.
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Lower-cases A-Z only, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW_BITS, _CHUNK = 10, 1 << 20
_POW = np.cumprod(np.full(1 << _LOW_BITS, 0x9E3779B97F4A7C15, np.uint64))
_HIGH = np.cumprod(np.full(1 << 16, 0xD1342543DE82EF95, np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, on a local master only."""
    context = spark.sparkContext
    if not (where := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where := tempfile.mkdtemp(prefix="spark-"))
    return where


#: Spark's setting that frees a query's shuffle files when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: survives lost executors, cuts the lineage.

    Its size is the files' own, so plans that join it with itself again and again keep small statistics. The shuffles that
    made it are needed no more and are freed at once.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands what this worker has freed back to the system: a worker stays for later stages, and would else hold its largest task's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def tidied(run):
    """run, a function over the batches of a task, with `give_back` once they are through."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def free_name(columns: list[str], base: str) -> str:
    """base, with as many underscores after it as it takes to be no column's name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word. data: UTF-8 bytes of documents laid end to end; offsets: their bounds."""
    inside = ~_IS_SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[offsets] = True
    start = np.flatnonzero(inside & first[:-1])
    last = np.ones(len(data) + 1, bool)
    last[1:-1] = ~inside[1:]
    last[offsets] = True
    end = np.flatnonzero(inside & last[1:]) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, by its bytes and their places; in pieces, so that memory stays small for any text."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _CHUNK, "right")))
        s, n = start[at:to], end[at:to] - start[at:to]
        bound = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(bound[-1]) - np.repeat(bound[:-1], n)
        value = _BYTE[data[place + np.repeat(s, n)]] * _POW[place & (1 << _LOW_BITS) - 1]
        if n.max() > 1 << _LOW_BITS:
            value = value * _HIGH[(place >> _LOW_BITS) & 0xFFFF]
        out[at:to] = mix(np.add.reduceat(value, bound[:-1]) + n.astype(np.uint64))
        at = to
    return out


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each k consecutive entries of words (documents aren't told apart: the caller masks windows that cross them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor, step = np.uint64(1), np.uint64((0xA0761D6478BD642F * (2 * seed + 1)) % 2**64 | 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += words[j : j + n] * factor
            factor = factor * step
    return mix(total)


def slices(texts, ids, most: int = 1 << 20):
    """(data, offsets, ids) for runs of documents of an Arrow batch, each run of about `most` bytes; nulls count as empty."""
    import pyarrow as pa

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], ids[at:to]
        at = to


def bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits as bytes, set where the column `place` says; made by Spark, at most 2**(bits - 6) rows come back."""
    from pyspark.sql import functions as F

    words = places.groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    out = np.zeros(1 << bits - 6, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.bits
    return out.view(np.uint8)


#: A key is hot when it has over a thousandth of the rows, so that there are a thousand hot keys at most.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on key, which right has once each. The rows of hot keys stay where they are and get right's rows, a thousand at most, sent.

    Both sides are read several times: give tables.
    """
    from pyspark.sql import functions as F

    least = left.count() / HOT_SHARE
    hot = F.broadcast(written(left.groupBy(key).count().where((F.col("count") > least) & (F.col("count") > HOT_SHARE)).select(key)))
    some = right.join(hot, key, "left_semi")
    return left.join(hot, key, "left_anti").join(right, key).unionByName(left.join(hot, key, "left_semi").join(F.broadcast(some), key))
