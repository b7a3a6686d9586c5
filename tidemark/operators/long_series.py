"""Windows, running sums and scans along series of any length, of which no task sees a whole one.

Three ways, by what a row needs of those before it:
- so many rows before: the series is cut into blocks of consecutive rows, each with a copy of the rows at its edge (`in_blocks`);
- a sum over all rows before: cells add up, sums run over cells, then over the rows of a cell (`sums_before`, `cumulative_zscore`);
- a state carried on by affine steps: the steps of a cell make one, those of a thousand cells one again (`states_before`, `scan`).

A cell is a whole number or a date that never falls along the order, some thousand rows each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.sinks import kept
from .ordered import matched

#: Rows of a block at least, and so many times as many as are copied in: what is copied stays a small share.
BLOCK_ROWS, BLOCK_TIMES = 4096, 4
#: Cells under one sum, as a power of two.
SUM_BITS = 16
#: Cells whose steps are put together at once, as a power of two.
STEP_BITS = 10


def place(df: DataFrame, cell: str) -> Column:
    """A cell as a whole number."""
    return F.unix_date(cell).cast("long") if dict(df.dtypes)[cell] == "date" else F.col(cell).cast("long")


def sums_before(cells: DataFrame, keys: list[str], cell: str, sums: list[str]) -> DataFrame:
    """A row for each row of `cells` (one a series and cell): keys, cell, and the sums of the cells before it, 0 before the first.

    Sums run over 65,536 neighbouring cells and over what those add up to, so no window is longer up to four billion cells a series.
    """
    at = cells.withColumn("_high", F.shiftright(place(cells, cell), SUM_BITS))
    high = at.groupBy(*keys, "_high").agg(*[F.sum(s).alias(s) for s in sums])
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    far = high.select(*keys, "_high", *[F.coalesce(F.sum(s).over(before(keys, "_high")), F.lit(0)).alias(f"_far_{s}") for s in sums])
    near = at.select(*keys, "_high", cell, *[F.coalesce(F.sum(s).over(before([*keys, "_high"], cell)), F.lit(0)).alias(s) for s in sums])
    return matched(near, far, [*keys, "_high"]).select(*keys, cell, *[(F.col(s) + F.col(f"_far_{s}")).alias(s) for s in sums])


def numbered(df: DataFrame, keys: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """df with the row's number in its series, from 1."""
    starts = sums_before(df.groupBy(*keys, cell).agg(F.count("*").alias("_start")), keys, cell, ["_start"])
    nth = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    return matched(df.withColumn("_nth", nth), starts, [*keys, cell]).withColumn(name, F.col("_start") + F.col("_nth")).drop("_nth", "_start")


def blocks(df: DataFrame, keys: list[str], cell: str, order: list[str], before: int, after: int = 0, rows: int | None = None) -> DataFrame:
    """df with its rows dealt to blocks of consecutive rows of a series, and copies of the `before` and `after` rows next to each block.

    New columns: _i (the row's number in its series), _block, _own (false for copies). A block has `rows` rows of its own, at
    least as many as are copied; by default so many that a quarter at most are copies.
    """
    rows = max(before, after, 1, rows or max(BLOCK_ROWS, BLOCK_TIMES * (before + after)))
    nth = numbered(df, keys, cell, order, "_i")
    block, within = F.floor((F.col("_i") - 1) / rows), (F.col("_i") - 1) % rows
    dealt = F.array_compact(F.array(block, F.when(within >= rows - before, block + 1), F.when((within < after) & (block > 0), block - 1)))
    out = nth.withColumn("_home", block).withColumn("_block", F.explode(dealt))
    return out.withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def in_blocks(df: DataFrame, keys: list[str], cell: str, order: list[str], before: int, build: Callable[[DataFrame, WindowSpec], DataFrame], after: int = 0, rows: int | None = None) -> DataFrame:
    """What `build` makes of df with the window that it is given, which stands for "along the series" as far as it reaches no more
    than `before` rows back and `after` rows on, windows over windows counted together. build keeps the rows and may use every
    row-order function over frames of bounded length; its rows are those of df.
    """
    dealt = blocks(df, keys, cell, order, before, after, rows)
    made = build(dealt, Window.partitionBy(*keys, "_block").orderBy("_i"))
    return made.where("_own").drop("_i", "_block", "_own")


def cumulative_zscore(df: DataFrame, keys: list[str], cell: str, order: list[str], values: dict[str, str], floor: float = 1e-8) -> DataFrame:
    """df with, for each column of `values`, its distance from the mean of all rows so far, in deviations so far.

    values: value column to name of the new one. Population variance by E[x^2] - E[x]^2 with a floor; 0 for the first value of a
    series, null for null. Counts, sums and sums of squares add up by cell.
    """
    parts, names = [], []
    for n, v in enumerate(values):
        x = F.col(v).cast("double")
        parts += [F.count(v).alias(f"_n{n}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"_s{n}"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"_q{n}")]
        names += [f"_n{n}", f"_s{n}", f"_q{n}"]
    start = sums_before(df.groupBy(*keys, cell).agg(*parts), keys, cell, names)
    here = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = matched(df, start, [*keys, cell])
    made = {}
    for n, (v, name) in enumerate(values.items()):
        x = F.col(v).cast("double")
        count = F.col(f"_n{n}") + F.count(v).over(here)
        mean = (F.col(f"_s{n}") + F.coalesce(F.sum(x).over(here), F.lit(0.0))) / count
        square = (F.col(f"_q{n}") + F.coalesce(F.sum(x * x).over(here), F.lit(0.0))) / count
        made[name] = F.when(F.col(v).isNotNull(), F.when(count < 2, 0.0).otherwise((x - mean) / F.sqrt(F.greatest(square - mean * mean, F.lit(floor)))))
    return rows.withColumns(made).drop(*names)


def affine_prefix(a: np.ndarray, b: np.ndarray, nth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The steps h -> a[i] * h + b[i] put together from the first to each one, for all columns at once, by doubling the reach.

    nth: the number from 0 of each step in its own series, where several follow one another; none of them reaches into the one before.
    """
    a, b, reach = a.copy(), b.copy(), 1
    while nth is not None and reach <= nth.max(initial=0):
        far = np.flatnonzero(nth >= reach)
        b[far] += a[far] * b[far - reach]
        a[far] *= a[far - reach]
        reach *= 2
    while nth is None and reach < len(a):
        b[reach:] += a[reach:] * b[:-reach]
        a[reach:] *= a[:-reach]
        reach *= 2
    return a, b


def _matrix(column) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _lists(values: np.ndarray):
    import pyarrow as pa

    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width or 1, dtype=np.int32)[: n + 1]), pa.array(values.ravel()))


def states_before(steps: DataFrame, keys: list[str], cell: str, a: str, b: str) -> DataFrame:
    """A row for each row of `steps` (one a series and cell): keys, cell, and `state`, the array of numbers that the cell starts from.

    a and b are arrays of one length: a cell turns a state h into a * h + b, position by position; a series starts from zeros.
    Groups of 1,024 neighbouring cells become one step each, level by level, until a series is one group; then the states go
    down again. Each level is a shuffle of a thousandth of the rows of the one before, so the work is linear in the cells.
    """
    ship(steps.sparkSession)
    kinds, names = dict(steps.dtypes), [f"_k{n}" for n in range(len(keys))]
    head = "".join(f"{n} {kinds[k]}, " for k, n in zip(keys, names, strict=True))
    level = kept(steps.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], place(steps, cell).alias("_at"), F.col(cell).alias("_cell"), F.col(a).alias("_a"), F.col(b).alias("_b")))
    ends = level.agg(F.min("_at"), F.max("_at")).first()  # two numbers
    up, shift = [level], 0
    while ends[0] is not None and ends[0] >> shift != ends[1] >> shift:
        shift += STEP_BITS

        def together(table):
            import pyarrow as pa

            table = table.sort_by("_at")
            x, y = affine_prefix(_matrix(table.column("_a")), _matrix(table.column("_b")))
            return pa.table([table.column(n)[-1:] for n in names] + [table.column("_group")[-1:], _lists(x[-1:]), _lists(y[-1:])], names=[*names, "_at", "_a", "_b"])

        grouped = up[-1].withColumn("_group", F.shiftright("_at", STEP_BITS)).select(*names, "_group", "_at", "_a", "_b")
        up.append(kept(grouped.groupBy(*names, "_group").applyInArrow(together, f"{head}_at long, _a array<double>, _b array<double>")))
    state = up[-1].select(*names, F.col("_at").alias("_group"), F.transform("_a", lambda _: F.lit(0.0)).alias("_state"))

    def down(table):
        import pyarrow as pa

        table = table.sort_by("_at")
        x, y = affine_prefix(_matrix(table.column("_a")), _matrix(table.column("_b")))
        first = _matrix(table.column("_state"))[:1]
        states = np.concatenate((first, x[:-1] * first + y[:-1]))
        return pa.table([table.column(n) for n in names] + [table.column("_at"), _lists(states)], names=[*names, "_group", "_state"])

    for below in reversed(up[:-1]):
        rows = below.select(*names, "_at", "_a", "_b", F.shiftright("_at", STEP_BITS).alias("_group"))
        state = matched(rows, state, [*names, "_group"]).groupBy(*names, "_group").applyInArrow(down, f"{head}_group long, _state array<double>")
    out = matched(level.select(*names, F.col("_at").alias("_group"), "_cell"), state, [*names, "_group"])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("_cell").alias(cell), F.col("_state").alias("state"))


#: Rows whose steps a scan puts together at once.
SCAN_ROWS = 4096


def _scanned(x: np.ndarray, dt: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """sum of c * state after each row (none without c), and the last state."""
    out = np.zeros(len(x) if c is not None else 0)
    for at in range(0, len(x), SCAN_ROWS):
        part = slice(at, at + SCAN_ROWS)
        decay, h = affine_prefix(np.exp(dt[part, None] * a), dt[part, None] * b[part] * x[part, None])
        h += decay * state
        if c is not None:
            out[part] = (c[part] * h).sum(1)
        state = h[-1]
    return out, state


def scan(df: DataFrame, keys: list[str], cell: str, order: list[str], x: str, dt: str, a: list[float], b: str, c: str, skip: float, out: str) -> DataFrame:
    """df with y: along each series h_n = exp(dt * a_n) * h_n + dt * b_n * x for every state n at once, y = sum of c_n * h_n, plus skip * x.

    b and c are array columns, a number for each state; rates a are 0 or less. Null x, dt, and null in b or c count as 0. The rows
    are shuffled by cell once for the cells' steps and once more for the results, whatever the number of states; a task holds a cell.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    zeros = F.array_repeat(F.lit(0.0), len(a))
    weights = lambda v: F.transform(F.coalesce(F.col(v).cast("array<double>"), zeros), lambda w: F.coalesce(w, F.lit(0.0)))
    rows = df.withColumns({"_x": F.coalesce(F.col(x).cast("double"), F.lit(0.0)), "_dt": F.coalesce(F.col(dt).cast("double"), F.lit(0.0)), "_b": weights(b), "_c": weights(c)})
    rates, by = np.array(a, float), [(o, "ascending") for o in order]
    numbers = lambda table: (table.column("_x").to_numpy(), table.column("_dt").to_numpy(), _matrix(table.column("_b")))

    def step(table):
        import pyarrow as pa

        u, d, w = numbers(table := table.sort_by(by))
        _, state = _scanned(u, d, w, rates, np.zeros(len(rates)), None)
        return pa.table([table.column(n)[:1] for n in [*keys, cell]] + [_lists(np.exp(d.sum() * rates)[None]), _lists(state[None])], names=[*keys, cell, "_a", "_h"])

    head = "".join(f"`{n}` {kinds[n]}, " for n in [*keys, cell])
    needed = rows.select(*dict.fromkeys([*keys, cell, *order, "_x", "_dt", "_b"]))
    steps = needed.groupBy(*keys, cell).applyInArrow(step, f"{head}_a array<double>, _h array<double>")
    starts = states_before(steps, keys, cell, "_a", "_h")

    columns = df.columns

    def result(table, start):
        import pyarrow as pa

        u, d, w = numbers(table := table.sort_by(by))
        y, _ = _scanned(u, d, w, rates, _matrix(start.column("state"))[0], _matrix(table.column("_c")))
        return table.select(columns).append_column(out, pa.array(y + skip * u))

    schema = ", ".join([f"`{n}` {k}" for n, k in df.dtypes] + [f"`{out}` double"])
    return rows.groupBy(*keys, cell).cogroup(starts.groupBy(*keys, cell)).applyInArrow(result, schema)


def ranks_within(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place i of values how many of values[start[i]:end[i]] are no larger than values[i].

    Values become ranks, ranks are taken apart bit by bit from the highest: one pass over the array per bit sorts it by that bit
    and moves every range along, so a range of any length costs as many steps as ranks have bits.
    """
    _, rank = np.unique(values, return_inverse=True)
    sequence, wanted, count = rank, rank + 1, np.zeros(len(values), np.int64)
    low, high = start.copy(), end.copy()
    for bit in range(int(wanted.max(initial=1)).bit_length() - 1, -1, -1):
        zero = (sequence >> bit) & 1 == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        low0, high0, one = zeros[low], zeros[high], (wanted >> bit) & 1 == 1
        count += np.where(one, high0 - low0, 0)
        low, high = np.where(one, zeros[-1] + low - low0, low0), np.where(one, zeros[-1] + high - high0, high0)
        sequence = np.concatenate((sequence[zero], sequence[~zero]))
    return count


def percentile_rank(df: DataFrame, keys: list[str], cell: str, order: list[str], x: str, k: int, name: str, rows: int | None = None) -> DataFrame:
    """keys, order and the share of the last k values no larger than this one, for windows of any length; null until k rows are there.

    A task counts for a block of rows of a series with the k - 1 before it, all at once. Values aren't null.
    """
    ship(df.sparkSession)
    dealt = blocks(df.select(*dict.fromkeys([*keys, cell, *order]), F.col(x).cast("double").alias("_x")), keys, cell, order, k - 1, rows=rows or max(16384, k))
    kinds = dict(dealt.dtypes)

    def run(table):
        import pyarrow as pa

        table = table.sort_by("_i")
        at, own = table.column("_i").to_numpy(), table.column("_own").to_numpy()
        places = np.arange(len(at))
        found = ranks_within(table.column("_x").to_numpy(), np.maximum(places - k + 1, 0), places + 1)
        shares = pa.array(found / k, mask=at < k)
        return table.append_column(name, shares).filter(pa.array(own)).select([*keys, *order, name])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*keys, *order]] + [f"`{name}` double"])
    return dealt.groupBy(*keys, "_block").applyInArrow(run, schema)
