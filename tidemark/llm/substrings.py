"""Removal of exact repeats of 13 words, by fixed-block anchors.

Every document's non-overlapping 7-word blocks are the index; every rolling 7-word window of every document probes it. A
13-word window that two documents share holds a whole block of either, so a hit lies in it. Around the hits, and only
there, the 13-word windows are compared by 80-bit hashes: each finds the smallest doc_id that holds it, and windows that
lie side by side extend a hit to its maximal repeat. Words covered by a window of a smaller document go.

Hashes travel packed: a task sends one row per bucket for a few megabytes of text, about five bytes a window, and of a
window that many documents of those megabytes share only one entry; the other documents are told the places at once, as
runs. Buckets grow in number with the input, so that each has a few million windows, and the slices of text grow with them.
A window in a third of all documents so fills one entry a slice, all in one bucket.

Two windows that differ share an 80-bit hash with a chance of 2**-80 a pair, made of 64-bit hashes of words: among the windows of
100 TB of text (some 1.6 * 10**13) about a hundred may be taken for one of another document; at 30 GB the chance of any is 10**-5.

A null text has no words. Documents under 13 words lose none. Rows that share a doc_id never remove each other's words; each of
them gets its own verdict. Rows alike in id and text go through once and come out as often as they came in; different texts of one
id travel under (doc_id, part), part a hash of the text, so no text meets the hits of another. A window that many texts of
one id share has an entry for each of them. A row without a doc_id removes nothing and loses nothing. Every row gives one
row. An empty table gives an empty result. Columns of df but the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, slices, window_hashes, words_of, written

BLOCK, WINDOW = 7, 13
IN_BUCKET = 2 << 20
PACKED = "bucket int, doc_id long, part long, blob binary"
#: Ids on several rows are sent to every task up to so many, else joined.
SENT = 1 << 20
LOCAL = -1  # bucket of rows that a task settled by itself, in the answers


def slice_bytes(bits: int) -> int:
    """How much text is packed at once for 2**bits buckets."""
    return min(8, max(2, (1 << bits) // 128)) << 20


def _inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words lie in one document."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.empty(0, bool)


def _runs(sorted_doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run."""
    cuts = np.flatnonzero(np.diff(sorted_doc)) + 1
    bounds = [0, *cuts.tolist(), len(sorted_doc)]
    return [(int(sorted_doc[a]), a, b) for a, b in zip(bounds, bounds[1:], strict=False)] if len(sorted_doc) else []


def _batch(rows: list[tuple]):
    import pyarrow as pa

    b, i, p, x = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [pa.array(b, pa.int32()), pa.array(i, pa.int64()), pa.array(p, pa.int64()), pa.array(x, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "part", "blob"])


def _spans(places: np.ndarray) -> bytes:
    """Ascending places as (start, length) of their runs."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    start = places[np.concatenate(([0], cuts))]
    return np.column_stack([start, np.diff(np.append(np.concatenate(([0], cuts)), len(places)))]).astype(np.int32).tobytes()


def _mark(mask: np.ndarray, spans: bytes) -> None:
    """Sets the places of spans that mask has."""
    for start, length in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
        mask[start : start + length] = True


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of numbers, all the lowest first: small ones compress to little."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _of_planes(data: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, n).T.copy().view(kind).ravel()


def packed(
    ids: np.ndarray, part: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray, check: np.ndarray, block: np.ndarray, bits: int, tags: list[bytes] | None = None
) -> list[tuple]:
    """Rows of PACKED for the windows of one slice.

    doc: index into ids and part; place: where in its document; key, check: hashes; block: whether the window is one of the index.
    For each different hash the smallest id is sent, with each of its texts, to the hash's bucket. The other documents that hold it
    are settled: they get a row of their own, dealt to buckets under zero, with the places. tags, one a document, ask for wide
    hashes and start the settled rows; without tags the smallest holder is settled too, for it needs the places as well.
    """
    wide = tags is not None
    order = np.lexsort((part[doc], ids[doc], key))
    key, check, doc, place, block = key[order], check[order], doc[order], place[order], block[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    smallest, largest = ids[doc[head]], ids[doc[np.append(head[1:], len(key)) - 1]] if len(head) else ids[:0]
    several = smallest != largest
    settled = (several[group] & (ids[doc] != smallest[group])) if wide else several[group]
    rows = []
    if settled.any():
        d, at = doc[settled], place[settled]
        order = np.lexsort((at, d))
        d, at = d[order], at[order]
        rows += [(-2 - (int(ids[i]) + int(part[i])) % (1 << bits), int(ids[i]), int(part[i]), (tags[i] if wide else b"") + _spans(at[a:b])) for i, a, b in _runs(d)]
    any_block = np.bitwise_or.reduceat(block, head) if len(head) else block[:0]
    sent = new.copy()
    sent[1:] |= (ids[doc[1:]] == smallest[group[1:]]) & (part[doc[1:]] != part[doc[:-1]])
    any_block, several = any_block[group[sent]], several[group[sent]]
    key, check, doc = key[sent], check[sent], doc[sent]
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    order = np.lexsort((doc, bucket))
    bucket, key, check, doc, any_block, several = (x[order] for x in (bucket, key, check, doc, any_block, several))
    for b, at, to in _runs(bucket):
        own, count = np.unique(doc[at:to], return_counts=True)
        sizes = np.array([to - at, len(own)], np.int32).tobytes()
        # Ids as steps between neighbours, parts (zeros where an id has one text), entries of each, and two bits an entry.
        small = _planes(np.diff(ids[own], prepend=0)) + _planes(part[own]) + _planes(count.astype(np.uint32))
        small += np.packbits(any_block[at:to].astype(bool)).tobytes() + np.packbits(several[at:to]).tobytes()
        body = key[at:to].tobytes() + check[at:to].astype(np.uint16).tobytes() if wide else (key[at:to] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
        rows.append((b, 0, 0, sizes + body + zlib.compress(small, 1)))
    return rows


def _unpacked(blob: bytes, wide: bool) -> tuple[np.ndarray, ...]:
    """Keys, checks, ids, parts, and flags: 1 for a block, 2 for a hash of several documents."""
    n, m = np.frombuffer(blob, np.int32, 2).tolist()
    key = np.frombuffer(blob, np.uint64 if wide else np.uint32, n, 8).astype(np.uint64)
    at = 8 + n * (8 if wide else 4)
    check = np.frombuffer(blob, np.uint16, n, at) if wide else np.zeros(n, np.uint16)
    rest = zlib.decompress(blob[at + (2 * n if wide else 0) :])
    ids, part, count = np.cumsum(_of_planes(rest[: 8 * m], np.int64, m)), _of_planes(rest[8 * m : 16 * m], np.int64, m), _of_planes(rest[16 * m : 20 * m], np.uint32, m)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8, offset=20 * m).reshape(2, -1), axis=1)[:, :n]
    return key, check, np.repeat(ids, count), np.repeat(part, count), bits[0] | bits[1] << 1


def answers(sent: DataFrame, wide: bool) -> DataFrame:
    """Rows (bucket, doc_id, part, blob): what matters to a document, by hash or, where bucket is LOCAL, by place. Narrow: windows it
    shares with another document, one of them as a block. Wide: those that a smaller document holds as well."""

    def run(key, table):
        import pyarrow as pa

        bucket = key[0].as_py()
        if bucket < 0:  # settled where they were
            kept = ["doc_id", "part", "blob"]
            return pa.Table.from_arrays([pa.array([LOCAL] * table.num_rows, pa.int32()), *table.select(kept).columns], ["bucket", *kept])
        keys, checks, ids, parts, flags = (np.concatenate(x) for x in zip(*(_unpacked(b.as_py(), wide) for b in table.column("blob")), strict=True))
        order = np.lexsort((ids, checks, keys))
        keys, checks, ids, parts, flags = keys[order], checks[order], ids[order], parts[order], flags[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        smallest, largest = ids[first], ids[np.append(first[1:], len(ids)) - 1]
        if wide:
            told = ids > smallest[group]
        else:
            every = np.bitwise_or.reduceat(flags, first)
            told = (((smallest != largest) | (every & 2 > 0)) & (every & 1 > 0))[group]
        ids, parts, keys = ids[told], parts[told], keys[told]
        order = np.lexsort((parts, ids))
        ids, parts, keys = ids[order], parts[order], keys[order] if wide else keys[order].astype(np.uint32)
        other = np.zeros(len(ids), np.int64)
        other[1:] = (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])
        rows = [(bucket, int(ids[a]), int(parts[a]), keys[a:b].tobytes()) for _, a, b in _runs(np.cumsum(other))]
        return pa.Table.from_batches([_batch(rows)])

    return sent.groupBy("bucket").applyInArrow(run, PACKED)


def _tag(text: bytes) -> bytes:
    """Tells rows of one doc_id and different words apart."""
    return hashlib.blake2b(text, digest_size=8).digest()


def _hashed(text: bytes, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    start, end, _ = words_of(data, np.array([0, len(data)]))
    return start, end, window_hashes(hash_words(data, start, end), k, seed)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept_text: the kept words joined by one space."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = written(docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")))
    total = ids.agg(F.sum("bytes")).first()[0] or 0
    repeated = ids.where("doc_id is not null and n > 1").select("doc_id")
    many = repeated.count()
    # A row without an id matches nothing; its part only spreads such rows.
    part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    docs = docs.select("doc_id", part.alias("part"), F.lit(1).cast("long").alias("n"), "text")
    if many:
        told = F.broadcast(repeated) if many <= SENT else repeated
        alike = docs.join(told, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
        alike = written(alike.select("doc_id", F.xxhash64("text").alias("part"), "n", "text"))
        docs = docs.join(told, "doc_id", "left_anti").unionByName(alike)
    keys = ["doc_id", "part"]
    bits = max(6, ceil(log2(max(1, total / 6 / IN_BUCKET))))

    def probes(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            who = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)])
            for data, offsets, own_keys in slices(batch.column(2), who, slice_bytes(bits)):
                start, end, doc = words_of(data, offsets)
                inside = _inside(doc, BLOCK)
                if not inside.any():
                    continue
                key, own = window_hashes(hash_words(data, start, end), BLOCK)[inside], doc[: len(inside)][inside]
                place = (np.arange(len(doc)) - np.searchsorted(doc, doc, "left"))[: len(inside)][inside]
                yield _batch(packed(*own_keys.T, own, place, key, np.zeros(len(key), np.uint16), (place % BLOCK == 0).astype(np.uint8), bits))

    probed = docs.select("doc_id", "part", "text").mapInArrow(probes, PACKED)
    hits = answers(probed, False).groupBy(*keys).agg(F.collect_list(F.struct("bucket", "blob")).alias("hits"))

    def near_hits(batches):
        """Documents without hits are finished; the others are kept with the places of the windows to compare."""
        import pyarrow as pa

        names, kinds = ["doc_id", "part", "n", "n_words", "done", "places", "packed"], [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for i, p, n_rows, text, found in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), batch.column(4), strict=True):
                raw = zlib.decompress(text.as_py())
                places = np.empty(0, np.uint32)
                if found.is_valid:
                    start, _, h = _hashed(raw, BLOCK)
                    hit, narrow = np.zeros(len(h), bool), [np.empty(0, np.uint64)]
                    for x in found.as_py():
                        if x["bucket"] == LOCAL:
                            _mark(hit, x["blob"])
                        else:
                            narrow.append(np.frombuffer(x["blob"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"]) << np.uint64(32))
                    hit |= np.isin((h >> np.uint64(64 - bits)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF), np.concatenate(narrow))
                    n = len(start) - WINDOW + 1
                    if n > 0:
                        upto = np.concatenate(([0], np.cumsum(hit)))
                        places = np.flatnonzero(upto[WINDOW - BLOCK + 1 :][:n] > upto[:n]).astype(np.uint32)
                words = raw.split()
                if len(places) or keep_text:
                    out.append((i, p, n_rows, len(words), None, zlib.compress(places.tobytes(), 1), text.as_py()))
                else:
                    out.append((i, p, n_rows, len(words), hashlib.sha256(raw).hexdigest(), None, None))
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def words_only(batches):
        """Each document's words joined by one space, compressed for the way."""
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = [zlib.compress(b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").split()), 2) for t in batch.column(3).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, 512) for c in range(3)], pa.array(texts, pa.binary())], ["doc_id", "part", "n", "text"])

    bare = docs.mapInArrow(words_only, "doc_id long, part long, n long, text binary")
    near = bare.join(hits, keys, "left").select(*keys, "n", "text", "hits")
    state = written(near.mapInArrow(near_hits, "doc_id long, part long, n long, n_words long, done string, places binary, packed binary"))
    pending = state.where("done is null")

    def windows(batches):
        def flush(who, tags, parts):
            key, check, place, doc = map(np.concatenate, zip(*parts, strict=True))
            return _batch(packed(*np.array(who).T, doc, place, key, check, np.zeros(len(key), np.uint8), bits, tags))

        for batch in batches:
            who, tags, parts, held = [], [], [], 0
            for i, part, places, text in zip(*(batch.column(c) for c in range(4)), strict=True):
                if not places.is_valid or not i.is_valid:
                    continue
                p, raw = np.frombuffer(zlib.decompress(places.as_py()), np.uint32), zlib.decompress(text.as_py())
                parts.append((_hashed(raw, WINDOW)[2][p], _hashed(raw, WINDOW, 2)[2][p], p.astype(np.int64), np.full(len(p), len(who))))
                who.append((i.as_py(), part.as_py()))
                tags.append(_tag(raw))
                if (held := held + len(raw)) >= slice_bytes(bits):
                    yield flush(who, tags, parts)
                    who, tags, parts, held = [], [], [], 0
            if parts:
                yield flush(who, tags, parts)

    compared = pending.select(*keys, "places", "packed").mapInArrow(windows, PACKED)
    verdicts = answers(compared, True).groupBy(*keys).agg(F.collect_list(F.struct("bucket", "blob")).alias("blobs"))

    def cleaned(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for i, n_rows, text, blobs in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in range(4)), strict=True):
                    words = (raw := zlib.decompress(text)).split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if blobs:
                        _, _, h = _hashed(raw, WINDOW)
                        told, tag = np.isin(h, np.concatenate([np.empty(0, np.uint64)] + [np.frombuffer(x["blob"], np.uint64) for x in blobs if x["bucket"] != LOCAL])), _tag(raw)
                        for x in blobs:
                            if x["bucket"] == LOCAL and x["blob"].startswith(tag):
                                _mark(told, x["blob"][len(tag) :])
                        starts = np.flatnonzero(told)
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, starts + WINDOW, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join(w for w, k in zip(words, stay.tolist(), strict=True) if k)
                    out.append((i, n_rows, len(words), int((~stay).sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if keep_text else [])))
                if out:
                    kinds = [pa.int64()] * 4 + [pa.string()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    rest = pending.select(*keys, "n", "packed").join(verdicts, keys, "left").select("doc_id", "n", "packed", "blobs").mapInArrow(cleaned, schema)
    if not keep_text:
        done = state.where("done is not null").select("doc_id", "n", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("done").alias("kept_sha256"))
        rest = done.unionByName(rest)
    if many:
        rest = rest.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return rest.drop("n")
