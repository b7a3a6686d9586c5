"""Exact Jaccard join on five-word shingles, in the metric space of shingle sets.

Equal sets are one point. The first pivots are the single-shingle sets: among those, a point's nearest are all its own
shingles, and two points within the threshold share one of the first (1 - t) * size + 1 of theirs in any common order. So
each point goes to the regions of its first shingles, rarest first by a sketch of fixed size, and links lose nothing.

A region knows how many of a point's shingles come before its own in that order. The first shingle that two points share
has none of the other's before it, so a pair is looked at only in regions where what follows is enough to link them.

In each region the point with the least before its shingle is the next pivot. Each point is measured against the pivot of one
of its regions first; near copies mostly come together by that. In a region that still has several components all others
are measured against its pivot; the region splits into rings by distance, with the triangle inequality as window: points whose distances differ by more than
1 - t can't link, so a ring meets its neighbour only. Rings that hold one component are finished; in the others, pivots of different components are measured
against the points of the other components, again and again, until none is left. A pair within a component is never
measured. So near copies cost one measure each, and no group's pairs are listed.

Links are 100 * intersection >= percent * union, in whole numbers. Documents of fewer than five words have one shingle,
the whole sequence; a null text or one without words has none and links with nothing, not even its like. Rows are told
apart by their texts: rows that share a doc_id are each judged by their own text, and a row without a doc_id links others
all the same (component_id is null where no row of the component has an id). Repeated rows cost one set. Columns of df
but the id and the text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from math import ceil, log2

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import LOWER, bit_map, give_back, hash_words, partitions, slices, tidied, window_hashes, words_of, written
from .components import components, merged

WORDS = 5
SKETCH_BITS, SKETCH_PARTS = 20, 16
IN_BUCKET = 1 << 20
RINGS_FROM = 32  # points; smaller regions are not split
MAP_BITS, MAP_EACH = 28, 32  # bits of the map of wanted rows: the most (32 MB), and for each row; beyond, no map
HOT = 1 << 20  # a shingle counted so often, and 64 times the sketch's mean, is dealt by text, not by bucket
PIVOTS = 8  # a region and round; twice as many each round


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted different shingle hashes of each document of a slice."""
    start, end, doc = words_of(data, offsets)
    h = hash_words(LOWER[data], start, end)
    n = len(offsets) - 1
    sets, owner = window_hashes(h, WORDS), doc[: max(0, len(doc) - WORDS + 1)]
    inside = owner == doc[WORDS - 1 :]
    sets, owner = sets[inside], owner[inside]
    sizes = np.bincount(doc, minlength=n)
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        first = np.searchsorted(doc, short)
        own = np.array([window_hashes(h[a : a + sizes[d]], int(sizes[d]), 100 + int(sizes[d]))[0] for d, a in zip(short.tolist(), first.tolist(), strict=True)], np.uint64)
        sets, owner = np.concatenate((sets, own)), np.concatenate((owner, short))
    order = np.lexsort((sets, owner))
    sets, owner = sets[order], owner[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
    sets, owner = sets[new], owner[new]
    return np.split(sets, np.searchsorted(owner, np.arange(1, n))) if n else []


def point(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def with_point(df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The rows of df with the point of their text as a column (binary, null without shingles)."""

    def points(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [point(s) for data, offsets, _ in slices(texts, texts) for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    return df.mapInArrow(tidied(points), StructType([*df.schema.fields, StructField(name, BinaryType())]))


def _prefix(size: int, percent: int) -> int:
    """How many shingles in common order must hold one of a linked set's."""
    return size - -(-percent * size // 100) + 1


def _survey(batches):
    """(doc_id, key, point, n) of each document, and the sketch: counts of shingles by hash, in parts."""
    import pyarrow as pa

    names, kinds = ["doc_id", "key", "point", "n", "part", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for data, offsets, at in slices(batch.column(1), np.arange(batch.num_rows)):
            sets = shingle_sets(data, offsets)
            if len(whole := np.concatenate(sets)):
                counts += np.bincount((whole >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            ids, keys = (batch.column(c).slice(int(at[0]), len(at)) for c in (0, 2))
            none = [pa.nulls(len(at), k) for k in kinds[4:]]
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array([point(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *none], names)
    for n, part in enumerate(np.split(counts, SKETCH_PARTS)):
        row = [None, None, None, None, n, zlib.compress(np.minimum(part, 2**32 - 1).astype(np.uint32).tobytes(), 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def _add(key, table):
    import pyarrow as pa

    total = sum(np.frombuffer(zlib.decompress(c.as_py()), np.uint32).astype(np.int64) for c in table.column("counts"))
    level = np.minimum(255, np.floor(np.log2(total + 1) * 8)).astype(np.uint8)  # 256 steps of frequency
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "level"])


def _pack(points: list[bytes], sizes: np.ndarray, owner: np.ndarray, key: np.ndarray, place: np.ndarray, bits: int, hot: np.ndarray):
    """One row a bucket: its (shingle, point, size, place of the shingle) entries of a slice. Hot ones go to a bucket under zero, by slice."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    bucket[hot] = -1 - zlib.crc32(points[0]) % (1 << bits)
    order = np.lexsort((owner, bucket))
    bucket, owner, key, place = bucket[order], owner[order], key[order], place[order]
    bounds = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(bucket)], strict=True):
        if b > a:
            own, index = np.unique(owner[a:b], return_inverse=True)
            rest = index.astype(np.int32).tobytes() + place[a:b].astype(np.int32).tobytes() + sizes[own].astype(np.int32).tobytes()
            yield int(bucket[a]), np.array([b - a, len(own)], np.int32).tobytes() + b"".join(points[i] for i in own) + key[a:b].tobytes() + zlib.compress(rest, 1)


def _has_partner(n: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Which points of a region may link with another one: sizes n, of which left shingles from the region's on.

    Two may where either's reach, (100 + percent) / percent * left - n, is at least the other's size.
    """
    reach = (100 + percent) * left - percent * n
    size = percent * n
    order = np.argsort(size, kind="stable")
    size, reach = size[order], reach[order]
    # The largest reach among the points no larger than each, whose it is, and the largest of the others.
    top, runner, owner, so_far = -1, -1, -1, []
    for i, x in enumerate(reach.tolist()):
        if x > top:
            top, runner, owner = x, top, i
        elif x > runner:
            runner = x
        so_far.append((top, runner, owner))
    tops, runners, owners = np.array(so_far).T
    last = np.searchsorted(size, reach, "right") - 1  # the largest point within reach
    other = np.where(owners[last] == np.arange(len(n)), runners[last], tops[last])
    stay = np.empty(len(n), bool)
    stay[order] = (last >= 0) & (other >= size)
    return stay


def _regions(percent: int, key, table):
    """Regions of two or more points, of one bucket: (region, point, n, place). Regions of the same points are one, with their least places.

    A bucket under zero has some entries of hot shingles: all of them are given out, for no task sees a hot region whole.
    """
    import pyarrow as pa

    keys, owners, places, points, sizes, base = [], [], [], [], [], 0
    for blob in table.column("blob"):
        blob = blob.as_py()
        n, m = np.frombuffer(blob, np.int32, 2).tolist()
        points.append(np.frombuffer(blob, "V16", m, 8))
        keys.append(np.frombuffer(blob, np.uint64, n, 8 + 16 * m))
        rest = np.frombuffer(zlib.decompress(blob[8 + 16 * m + 8 * n :]), np.int32)
        owners.append(rest[:n] + base)
        places.append(rest[n : 2 * n])
        sizes.append(rest[2 * n :])
        base += m
    keys, owners, places = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
    points, same = _unique(np.concatenate(points))
    size_of = np.zeros(len(points), np.int64)
    size_of[same] = np.concatenate(sizes)
    owners = same[owners]
    order = np.lexsort((owners, keys))
    keys, owners, places = keys[order], owners[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners, places = keys[new], owners[new], places[new]
    if key[0].as_py() < 0:
        columns = [pa.array((keys >> np.uint64(1)).astype(np.int64)), pa.array([points[i].tobytes() for i in owners], pa.binary()), pa.array(size_of[owners]), pa.array(places.astype(np.int64))]
        return pa.Table.from_arrays(columns, ["region", "point", "n", "place"])
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    region: dict[bytes, list] = {}
    for a, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
        members, at = owners[a : a + n], places[a : a + n]
        if (old := region.get(sign := members.tobytes())) is None:
            region[sign] = [int(keys[a] >> np.uint64(1)), members, at]
        else:
            old[2] = np.minimum(old[2], at)
    for sign, r in list(region.items()):
        stay = _has_partner(size_of[r[1]], size_of[r[1]] - r[2], percent)
        if stay.sum() < 2:
            del region[sign]
        elif not stay.all():
            r[1], r[2] = r[1][stay], r[2][stay]
    empty = [np.empty(0, np.int64)]
    ids = np.concatenate(empty + [np.full(len(m), r) for r, m, _ in region.values()])
    who = np.concatenate(empty + [m for _, m, _ in region.values()])
    at = np.concatenate(empty + [x for _, _, x in region.values()])
    columns = [pa.array(ids), pa.array([points[i].tobytes() for i in who], pa.binary()), pa.array(size_of[who]), pa.array(at.astype(np.int64))]
    return pa.Table.from_arrays(columns, ["region", "point", "n", "place"])


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = values.view(np.dtype([("a", ">u8"), ("b", ">u8")]))
    order = np.lexsort((pairs["b"], pairs["a"]))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    back = np.empty(len(pairs), np.int64)
    back[order] = np.cumsum(new) - 1
    return pairs[new], back


def _measure(batches):
    """(x, p, region..., shingles of both) to shared counts."""
    import pyarrow as pa

    for batch in batches:
        last, here = None, None
        out = []
        for p, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if p != last:
                last, here = p, np.frombuffer(b.as_py(), np.uint64)
            there = np.frombuffer(a.as_py(), np.uint64)
            at = np.searchsorted(here, there)
            out.append((len(there), len(here), int((here[np.minimum(at, len(here) - 1)] == there).sum())))
        n, m, shared = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(shared, pa.int64())], ["x", "p", "n", "m", "shared"])


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Rows: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), point (binary, null without shingles), root (one of the component's points)."""
    spark = df.sparkSession
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    survey = written(docs.mapInArrow(tidied(_survey), "doc_id long, key long, point binary, n long, part int, counts binary"))
    known = survey.where("part is null").select("doc_id", "key", "point", "n")
    levels = survey.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_add, "part int, level binary").collect()  # 2**SKETCH_BITS bytes
    level = np.frombuffer(b"".join(r.level for r in sorted(levels)), np.uint8) if len(levels) == SKETCH_PARTS else np.zeros(1 << SKETCH_BITS, np.uint8)
    hot_level = int(np.ceil(8 * np.log2(max(HOT, 64 * np.exp2(level / 8).mean()))))
    sketch = spark.sparkContext.broadcast(level)
    total = known.agg(F.sum("n")).first()[0] or 0
    bits = max(5, ceil(log2(max(1, total * (100 - percent) / 100 / IN_BUCKET))))

    def first_shingles(batches):
        import pyarrow as pa

        for batch in batches:
            for data, offsets, _ in slices(batch.column(0), batch.column(0), 4 << 20):
                points, owner, key, place, hot = {}, [], [], [], []
                for s in shingle_sets(data, offsets):
                    if len(s) and (p := point(s)) not in points:  # copies once
                        often = sketch.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                        rare = np.lexsort((s, often))[: _prefix(len(s), percent)]
                        owner.append(np.full(len(rare), len(points), np.int64))
                        key.append(s[rare])
                        place.append(np.arange(len(rare)))
                        hot.append(often[rare] >= hot_level)
                        points[p] = len(s)
                rows = list(_pack(list(points), np.array(list(points.values())), *map(np.concatenate, (owner, key, place)), bits, np.concatenate(hot))) if points else []
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    buckets = docs.select("text").mapInArrow(tidied(first_shingles), "bucket int, blob binary").groupBy("bucket")

    def of_bucket(key, table):
        give_back()  # of the bucket before
        return _regions(percent, key, table)

    regions = written(buckets.applyInArrow(of_bucket, "region long, point binary, n long, place long"))
    # The sets of the points that share a region with another, each from the whole text of one row: the least id that has one.
    one = known.where("point is not null").groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("row"))
    wanted = written(one.join(regions.select("point").distinct(), "point").select("point", F.xxhash64("row.doc_id", "row.key").alias("at")))
    map_bits = max(10, ceil(log2(MAP_EACH * max(1, wanted.count()))))
    place = lambda at: F.pmod(at, F.lit(1 << map_bits)).alias("place")
    # Spares most texts the shingling, where it has room for each; the join below is exact with and without it.
    asked = spark.sparkContext.broadcast(bit_map(wanted.select(place(F.col("at"))), map_bits)) if map_bits <= MAP_BITS else None

    def sets(batches):
        import pyarrow as pa

        given = set()  # a task gives out each point once
        for batch in batches:
            if asked is not None:
                at = batch.column(1).to_numpy()
                batch = batch.filter(pa.array(asked.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            for data, offsets, _ in slices(batch.column(0), batch.column(0)):
                found = [(p, s) for s in shingle_sets(data, offsets) if (p := point(s)) is not None and p not in given and not given.add(p)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["point", "shingles"])

    made = docs.select("text", place(F.xxhash64("doc_id", "key"))).mapInArrow(tidied(sets), "point binary, shingles binary")
    # Dealt by point once; the joins of every round use that. Blocks of a lost executor are made again from the texts.
    dealt = made.repartition(partitions(spark), "point").groupBy("point").agg(F.first("shingles").alias("shingles"))
    shingles = dealt.join(wanted.select("point"), "point", "left_semi").persist(StorageLevel.DISK_ONLY)

    def measured(pairs: DataFrame) -> DataFrame:
        x, p = shingles.select(F.col("point").alias("x"), F.col("shingles").alias("of_x")), shingles.select(F.col("point").alias("p"), F.col("shingles").alias("of_p"))
        p = p.join(pairs.select("p").distinct(), "p")  # few; a pivot that many points ask for is a skew that the next join splits
        both = pairs.join(x, "x").join(p, "p").select("x", "p", "of_x", "of_p").mapInArrow(tidied(_measure), "x binary, p binary, n long, m long, shared long")
        union = F.col("n") + F.col("m") - F.col("shared")
        return written(both.select("x", "p", (F.col("shared") * 100 >= union * percent).alias("link"), (1 - F.col("shared") / union).alias("distance")))

    def may_link(n, left, m, right):
        """Whether sets of n and m shingles can link of which left and right are at hand."""
        return F.least(left, right) * (100 + percent) >= (n + m) * percent

    def linked(rows: DataFrame) -> DataFrame:
        return rows.where("link").select(F.col("x").alias("a"), F.col("p").alias("b"))

    # First pivots of the regions. Each point is measured against one of them, that of the region which its rarest shingle makes.
    nearest = F.min_by(F.struct("point", "n", "place"), F.struct(F.col("place") / F.col("n"), "point"))
    pivots = regions.groupBy("region").agg(nearest.alias("p"), (F.count("*") >= RINGS_FROM).alias("large"))
    with_pivot = regions.join(pivots, "region").withColumn("left", F.col("n") - F.col("place")).withColumnRenamed("point", "x").where("x != p.point")
    possible = may_link(F.col("n"), F.col("left"), F.col("p.n"), F.col("p.n") - F.col("p.place"))
    with_pivot = written(with_pivot.select("region", "x", "n", "left", "place", "large", possible.alias("possible"), F.col("p.point").alias("p")))
    tested = measured(with_pivot.where("large or possible").groupBy("x").agg(F.min_by("p", F.struct("place", "p")).alias("p")))
    found = written(components(linked(tested)))
    # Where a region still has points of another component than its pivot's, those that may link with it are measured too, in a large one all.
    root_of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = with_pivot.join(root_of("x"), "x", "left").join(root_of("p"), "p", "left").withColumn("apart", F.coalesce("root_x", "x") != F.coalesce("root_p", "p"))
    apart = written(apart.drop("root_x", "root_p"))
    with_pivot = written(apart.join(apart.where("apart").select("region").distinct(), "region", "left_semi"))
    new = measured(with_pivot.where("large or (possible and apart)").select("x", "p").distinct().join(tested.select("x", "p"), ["x", "p"], "left_anti"))
    tested = tested.unionByName(new)
    if linked(new).limit(1).count():
        found = merged(found, linked(new))
    # Rings: a point lies in its own and is copied to the next; width 1 - t, less rounding.
    ring = F.floor(F.col("distance") / ((100 - percent) / 100 + 1e-9)).cast("int")
    rings = with_pivot.where("large").join(tested.select("x", "p", "distance"), ["x", "p"]).withColumn("ring", F.explode(F.array(ring, ring + 1)))
    rings = rings.unionByName(with_pivot.where("not large").withColumns({"distance": F.lit(0.0), "ring": F.lit(-1)}))
    rings = rings.select(F.xxhash64("region", "ring").alias("region"), F.col("x").alias("point"), "n", "left")

    def unsettled(rows: DataFrame) -> DataFrame:
        """(region, point, n, left, root) of the regions with more than one component, less the points too far from all others."""
        rows = rows.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
        of = rows.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least_n"), F.max("left").alias("most_left"))
        rows = rows.join(of.where("low < high"), "region").where(may_link(F.col("n"), F.col("left"), F.col("least_n"), F.col("most_left")))
        return rows.select("region", "point", "n", "left", "root")

    rest, most = written(unsettled(rings.groupBy("region", "point").agg(F.first("n").alias("n"), F.max("left").alias("left")))), PIVOTS
    while rest.limit(1).count():
        own = rest.groupBy("region", "root").agg(F.count("*").alias("of"), F.min_by(F.struct("point", "n", "left"), F.struct(-F.col("left") / F.col("n"), "point")).alias("p"))
        few = Window.partitionBy("region").orderBy("of", "p.point")
        chosen = own.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= most)
        pivot = written(chosen.select("region", F.col("p.point").alias("p"), F.col("p.n").alias("m"), F.col("p.left").alias("right"), F.col("root").alias("of_p")))
        pairs = rest.join(pivot, "region").where("root != of_p").where(may_link(F.col("n"), F.col("left"), F.col("m"), F.col("right"))).select(F.col("point").alias("x"), "p").distinct()
        new = measured(pairs.join(tested.select("x", "p"), ["x", "p"], "left_anti").join(tested.select(F.col("x").alias("p"), F.col("p").alias("x")), ["x", "p"], "left_anti"))
        tested = tested.unionByName(new)  # (x, p) of all rounds, files of their own
        if linked(new).limit(1).count():
            found = merged(found, linked(new))
        used = pivot.select("region", F.col("p").alias("point"))
        rest = written(unsettled(rest.drop("root").join(used, ["region", "point"], "left_anti")))
        most *= 2
    shingles.unpersist()
    roots = one.select("point", "doc_id").join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_point = roots.join(least, "root").select("point", "component_id", "root")
    out = known.where("point is not null").join(by_point, "point").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "point", "root")
    return out.unionByName(known.where("point is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "point", F.col("point").alias("root")))
