"""Histogram sort into shards of near-equal bytes.

The sort key is (hash of the text, hash of the id, number of the row), so that equal texts lie side by side. Splitters are
found by counting, again and again, the exact bytes below candidate boundaries over all rows, each round with finer probes
inside the interval that must hold the splitter, until it is within tolerance of its goal; then every row moves once. A
splitter falls between texts where tolerance allows, inside a group of equal texts only where the group is too large for
that, and between rows equal in text and id only where those are too many. Rows equal in both that are more than two cells
of a shard hold get numbers, and are stored with them, so that counting and moving see the same ones and no task gets
them all. DataFrame operations only.

Null text: size 1, hashed as null, its crc null. Null ids are one id. Repeated rows are rows of their own. An empty table
gives an empty result. A column of df that is named size, shard or slot is replaced, other names are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, partitions, written

BITS = 60


def hashed(*columns: Column) -> Column:
    """A key from 0 to 2**BITS - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def splitters(rows: DataFrame, key: str, goals: list[float], before: list[float], tolerance: float, whole: float, probes: int = 128) -> list[tuple[int, float, float, bool]]:
    """For each goal the boundary b whose bytes below (before + those of rows with key < b) are within tolerance of it: (b, bytes below, bytes at b, found).

    Where the interval shrinks to one key, its nearer side is taken if it is within `whole` of the goal, else found is false.
    rows: (key, size, part); goal i looks at the rows whose part is i, or at all rows where part is -1.
    """
    low, high, below, above = [0] * len(goals), [1 << BITS] * len(goals), list(before), [float("inf")] * len(goals)
    done: dict[int, tuple[int, float, float, bool]] = {}
    while len(done) < len(goals):
        open_ = [i for i in range(len(goals)) if i not in done]
        # One histogram a round: the cells of every open interval, exact bytes in each. At most goals * probes rows come back.
        here = lambda i: (F.col(key) >= low[i]) & (F.col(key) < high[i]) & F.col("part").isin(-1, i)
        cell = lambda i: F.expr(f"({key} - {low[i]}L) div {max(1, -(-(high[i] - low[i]) // probes))}L").alias("cell")
        cells = F.array(*[F.when(here(i), F.struct(F.lit(i).alias("goal"), cell(i))) for i in open_])
        counted = rows.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c"), "size").groupBy("c.goal", "c.cell").agg(F.sum("size").alias("bytes")).collect()
        for i in open_:
            width = max(1, -(-(high[i] - low[i]) // probes))
            running = below[i]
            for r in sorted((r for r in counted if r.goal == i), key=lambda r: r.cell):
                start = low[i] + r.cell * width
                if running + r.bytes >= goals[i]:  # the goal is in this cell
                    near = min(((start, running), (start + width, running + r.bytes)), key=lambda x: abs(x[1] - goals[i]))
                    if abs(near[1] - goals[i]) <= (whole if width == 1 else tolerance):
                        done[i] = (near[0], near[1], 0.0, True)
                    elif width == 1:
                        done[i] = (start, running, float(r.bytes), False)
                    else:
                        low[i], high[i], below[i] = start, min(high[i], start + width), running
                    break
                running += r.bytes
            else:
                done[i] = (high[i], running, 0.0, True)
    return [done[i] for i in range(len(goals))]


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, whole: float = 0.02, cell_bytes: int = 64 << 20) -> DataFrame:
    """The rows of df with size, shard (0 to shards - 1), slot (gapless from 0 in a shard); sorted by key within each cell of a shard.

    tolerance: of a shard's mean bytes; whole: the error, likewise, up to which a group of equal texts is not split.
    """
    spark = df.sparkSession
    k1, k2, k3, k4, to, cell, start, nth = (free_name(df.columns, c) for c in ("_k1", "_k2", "_k3", "_k4", "_shard", "_cell", "_start", "_nth"))
    new = {k1: hashed(F.col(text_col)), k2: hashed(F.col(id_col), F.lit(1)), k3: F.lit(0).cast("long"), "size": (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")}
    keyed = df.withColumns(new)
    narrow = written(keyed.select(k1, k2, k3, "size"))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    cells = max(128, -(-total // (shards * cell_bytes)))
    # Rows alike in text and id are numbered where they are more than two cells' worth; there is one such group for two cells at most.
    many = narrow.groupBy(k1, k2).agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (shards * cells) > 2 * total).select(k1, k2, F.lit(True).alias(k4))
    if not many.isEmpty():
        number = F.when(F.col(k4), hashed(F.monotonically_increasing_id(), F.lit(3))).otherwise(F.lit(0).cast("long"))
        keyed = written(keyed.join(F.broadcast(many), [k1, k2], "left").withColumn(k3, number).drop(k4))
        narrow = keyed.select(k1, k2, k3, "size")
    goals, mean = [total * i / shards for i in range(1, shards)], total / shards
    first = splitters(narrow.select(k1, "size", F.lit(-1).alias("part")), k1, goals, [0.0] * len(goals), tolerance * mean, whole * mean)
    bounds = [(b, 0, 0) for b, *_ in first]

    def inside(rows: DataFrame, above: list[str], key: str, goals_at: list[int], error: float) -> list[int]:
        """Bounds of the goals whose group is still whole, by the next part of the key; gives back those that need one more."""
        depth = len(above)
        member = F.array(*[F.when(F.struct(*above) == F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(above, bounds[i][:depth], strict=True)]), F.lit(n)) for n, i in enumerate(goals_at)])
        rows = rows.select(key, "size", F.explode(F.filter(member, lambda x: x.isNotNull())).alias("part"))
        found = splitters(rows, key, [goals[i] for i in goals_at], [before[i] for i in goals_at], tolerance * mean, error)
        for i, (b, below, *_) in zip(goals_at, found, strict=True):
            bounds[i] = (*bounds[i][:depth], b, *bounds[i][depth + 1 :])
            before[i] = below
        return [i for i, x in zip(goals_at, found, strict=True) if not x[3]]

    before = [x[1] for x in first]
    if hard := [i for i, x in enumerate(first) if not x[3]]:  # equal texts, too large a group to stay whole: split by id
        hard = inside(narrow, [k1], k2, hard, whole * mean)
    if hard:  # equal in id as well: split by number
        inside(narrow, [k1, k2], k3, hard, float("inf"))
    key = F.struct(k1, k2, k3)
    shard = sum((F.when(key >= F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip((k1, k2, k3), b, strict=True)]), 1).otherwise(0) for b in bounds), F.lit(0))
    # Cells of a shard by id and number, so that no group fills one; how many there are follows the bytes.
    place = {to: shard.cast("int"), cell: F.expr(f"(`{k2}` ^ `{k3}`) div {-(-(1 << BITS) // cells)}L").cast("int")}
    counts = narrow.withColumns(place).groupBy(to, cell).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(to).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(to, cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))
    moved = keyed.withColumns(place).repartition(partitions(spark), to, cell)
    order = Window.partitionBy(to, cell).orderBy(k1, k2, k3, F.col(id_col))
    moved = moved.withColumn(nth, F.row_number().over(order)).join(starts, [to, cell])
    out = moved.withColumns({"shard": F.col(to), "slot": (F.col(start) + F.col(nth) - 1).cast("long")})
    return out.drop(k1, k2, k3, to, cell, start, nth)
