"""Media columns in content-defined chunks.

Each text's UTF-8 bytes, padded with byte 255 to a positive multiple of 576, become the samples of an 8-bit grey image 24
pixels wide. A rolling gear hash cuts the stored file where its content says so, hence equal passages give equal chunks.
Chunk digests are counted over all rows; a chunk that occurs once stays in its document's ordered chunk list, one that
occurs again is stored once in a table of shared chunks. Reading back joins lists and shared chunks, checks every digest
and the whole file's, and computes features from the bytes read.

Which digests occur again is told to the tasks by a bit map with room for each of them: a false hit stores a single chunk
among the shared ones, which costs a join and changes nothing else. Where they are more than the largest map has room for,
there is no map: all chunks go to the shared table, where Spark groups them by digest, and come back by the same join.

A null text counts as empty: one tile of byte 255. Equal texts, repeated rows among them, give equal values, one row each.
An empty table gives an empty result. Columns of df but the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, hot_join, written

WIDTH, TILE, PAD = 24, 576, 255
LEAST, MOST, MASK = 512, 8192, np.uint32(0x3FF << 20)
GEAR = np.random.default_rng(576).integers(0, 2**32, 256, dtype=np.uint32)
MAP_BITS, MAP_EACH, MAP_HASHES = 28, 16, 3  # the largest map (32 MB), bits and places for each digest
CHUNKS = "array<struct<digest:binary,size:int,data:binary>>"
BATCH = 4 << 20


def stored_form(text: bytes) -> bytes:
    """The image file that holds the padded payload."""
    rows = max(1, -(-len(text) // TILE)) * TILE // WIDTH
    return b"P5\n%d %d\n%d\n" % (WIDTH, rows, PAD) + text.ljust(rows * WIDTH, b"\xff")


def payload_of(media: bytes) -> bytes:
    """The samples of an image file."""
    magic, shape, depth, data = media.split(b"\n", 3)
    width, rows = map(int, shape.split())
    if magic != b"P5" or int(depth) != PAD or len(data) != width * rows:
        raise ValueError("not an 8-bit image of this kind")
    return data


def cut(media: bytes) -> list[bytes]:
    """Content-defined chunks: a cut where the gear hash of the last 32 bytes has ten zero bits, LEAST to MOST bytes apart."""
    hashes = GEAR[np.frombuffer(media, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # windows of 2, 4, ... 32 bytes: hash = hash << 1 + gear, for all places at once
        older = hashes[:-shift] << np.uint32(shift)
        hashes = hashes.copy()
        hashes[shift:] += older
    out, last = [], 0
    for at in (np.flatnonzero((hashes & MASK) == 0) + 1).tolist():
        while at - last > MOST:
            out.append(media[last : last + MOST])
            last += MOST
        if at - last >= LEAST:
            out.append(media[last:at])
            last = at
    while last < len(media):
        out.append(media[last : last + MOST])
        last += MOST
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature(payload: bytes) -> str:
    """Rows, sum, sum of squares, energy of the first differences, and a histogram of 16 bins."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{len(x) // WIDTH}|{x.sum()}|{(x * x).sum()}|{(np.diff(x) ** 2).sum()}|{','.join(map(str, bins))}"


def _texts(batch):
    for t in batch.column(batch.num_columns - 1):
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def _digests(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            found = [digest(c) for t in _texts(batch.slice(at, 1024)) for c in cut(stored_form(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])


def _maybe(bits: np.ndarray | None):
    """Whether a digest may be in the bit map; always, without one."""
    if bits is None:
        return lambda d: True
    mask = 8 * len(bits) - 1

    def held(d: bytes) -> bool:
        return all(bits[p >> 3] >> (p & 7) & 1 for p in (int.from_bytes(d[4 * i : 4 * i + 4], "little") & mask for i in range(MAP_HASHES)))

    return held


def digest_map(digests: DataFrame) -> np.ndarray | None:
    """The bit map of MAP_HASHES places for each digest; None where it would be over MAP_BITS."""
    size = max(10, ceil(log2(MAP_EACH * max(1, digests.count()))))
    if size > MAP_BITS:
        return None
    hexes = F.hex("digest")
    place = [F.conv(F.concat(*[F.substring(hexes, 8 * i + 2 * (3 - j) + 1, 2) for j in range(4)]), 16, 10).cast("long").bitwiseAND((1 << size) - 1) for i in range(MAP_HASHES)]
    return bit_map(digests.select(F.explode(F.array(*place)).alias("place")), size)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables in the shared folder: documents (doc_id, n_bytes, media_bytes, media_sha256, chunks) and shared chunks (digest, data)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    again = written(rows.select("text").mapInArrow(_digests, "digest binary").groupBy("digest").count().where("count > 1").select("digest"))
    bits = rows.sparkSession.sparkContext.broadcast(digest_map(again))

    def lists(batches):
        import pyarrow as pa

        held = _maybe(bits.value)
        kind = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("data", pa.binary())])
        names, kinds = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "chunks"], [pa.int64()] * 3 + [pa.string(), pa.list_(kind)]
        for batch in batches:
            out, filled = [], 0
            for i, t in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                media = stored_form(t)
                parts = [(digest(c), c) for c in cut(media)]
                out.append((i, len(t), len(media), hashlib.sha256(media).hexdigest(), [{"digest": d, "size": len(c), "data": None if held(d) else c} for d, c in parts]))
                if (filled := filled + len(media)) > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, filled = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def shared(batches):
        import pyarrow as pa

        held = _maybe(bits.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = {digest(c): c for t in _texts(batch.slice(at, 512)) for c in cut(stored_form(t)) if held(digest(c))}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "data"])

    records = written(rows.mapInArrow(lists, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, chunks {CHUNKS}"))
    chunks = written(rows.select("text").mapInArrow(shared, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data")))
    return records, chunks


VALUES = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _read(batches):
    """(media_sha256, chunks) rows, chunks in order with their data: verified, then what the payload gives."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for sha, chunks in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256), strict=True):
                parts = chunks.as_py()
                if any(digest(c["data"]) != c["digest"] for c in parts):
                    raise ValueError(f"a chunk of media {sha} is damaged")
                media = b"".join(c["data"] for c in parts)
                if hashlib.sha256(media).hexdigest() != sha:
                    raise ValueError(f"media {sha} is damaged")
                payload = payload_of(media)
                out.append((sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], [x.split()[0] for x in VALUES.split(", ")])


def read_back(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks, n_shared."""
    whole = F.forall("chunks", lambda c: c.data.isNotNull())
    facts = ["doc_id", "n_bytes", "media_bytes", "media_sha256", F.size("chunks").alias("n_chunks"), F.size(F.filter("chunks", lambda c: c.data.isNull())).alias("n_shared")]
    own = F.struct(*facts).alias("facts")

    def alone(batches):
        import pyarrow as pa

        for batch in batches:
            values = list(_read([pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["media_sha256", "chunks"])]))
            done = pa.Table.from_batches(values).combine_chunks() if values else None
            if done is not None and done.num_rows:
                yield from pa.Table.from_arrays([batch.column(0), *done.columns[1:]], ["facts", *done.column_names[1:]]).to_batches()

    kind = records.select(own).schema["facts"].dataType.simpleString()
    values = VALUES.removeprefix("media_sha256 string, ")
    first = records.where(whole).select(own, "media_sha256", "chunks").mapInArrow(alone, f"facts {kind}, {values}").select("facts.*", "*").drop("facts")
    # Documents with shared chunks: each different file is put together once, then its values go to all that hold it.
    rest = records.where(~whole)
    different = rest.select("media_sha256", "chunks").groupBy("media_sha256").agg(F.first("chunks").alias("chunks"))
    parts = different.select("media_sha256", F.posexplode("chunks").alias("at", "c")).select("media_sha256", "at", "c.digest", F.col("c.data").alias("own"))
    apart = parts.where("own is null").join(chunks, "digest").select("media_sha256", "at", "digest", "data")
    parts = parts.where("own is not null").select("media_sha256", "at", "digest", F.col("own").alias("data")).unionByName(apart)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest", "data"))), lambda c: F.struct(c.digest.alias("digest"), c.data.alias("data")))
    done = written(parts.groupBy("media_sha256").agg(ordered.alias("chunks")).mapInArrow(_read, VALUES))
    second = hot_join(written(rest.select(*facts)), done, "media_sha256")  # a file that many rows hold isn't gathered
    return first.unionByName(second).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks", "n_shared")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_back(*store(df, id_col, text_col))
