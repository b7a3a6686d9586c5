"""Stateful operators over streams in event order: late and shuffled rows wait until the watermark has passed them.

The rows of a group of keys lie in a list of the state store, thousands to an entry. A timer at the earliest of them fires once the watermark is
past it; then all rows up to the watermark leave the list, in order, and the keys' states move over them, all keys at once. What later batches
bring is never earlier than that, since rows behind the watermark are dropped. A key that has had no rows for `idle` of event time
leaves the store, and starts anew when it comes again. The state store must be RocksDB, see `with_timers`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.shipping import ship
from .state import SLICE, places_in_order

#: The setting that names the state store, and the store that has timers and lists.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession, run: Callable):
    """run() with the state store that these operators take, then the session's own again."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(STORE, before)


#: Rows that are packed as one entry of a list.
PACK = 8192


class Advance(NamedTuple):
    """How states move over rows: `width` numbers a key, zeros at first.

    run(states, first, rows): states has a row for each key, rows is a frame of the keys' rows one key after another, each in order, and first says
    where each begins; returns the states after them and the frame of results.
    """

    width: int
    run: Callable


class InOrder(StatefulProcessor):
    """Rows of a group of keys in order of (key, time, order columns), given to `advance` with the states so far, a slice at a time.

    Rows wait as Arrow batches of neighbours in time, so those that stay are neither read nor written row by row; the states of a group are one
    batch too: calls to the store grow with the groups, not with the keys.
    """

    def __init__(self, kinds: StructType, key: str, time: str, order: list[str], advance: Advance, idle_ms: int):
        self.kinds, self.key, self.time, self.order, self.advance, self.idle = kinds, key, time, order, advance, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        # Times come and go without a zone.
        plain = [f.with_type(pa.timestamp("us")) if pa.types.is_timestamp(f.type) else f for f in to_arrow_schema(self.kinds)]
        self.schema = pa.schema(plain)
        self.states = pa.schema([self.schema.field(self.key).with_name("key"), ("last", pa.int64()), ("numbers", pa.list_(pa.float64()))])
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, latest long, rows binary")
        self.state = handle.getValueState("state", "states binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def _read(self, packed, schema):
        import pyarrow as pa

        return pa.ipc.read_record_batch(pa.py_buffer(bytes(packed)), schema)

    def _known(self):
        """Keys that have a state, the time in milliseconds of the last row that it moved over, and its numbers."""
        from ..operators.long_series import _matrix

        if not (found := self.state.get()):
            return self.states.empty_table().column("key").combine_chunks(), np.zeros(0, np.int64), np.zeros((0, self.advance.width))
        batch = self._read(found[0], self.states)
        return batch.column("key"), batch.column("last").to_numpy(), _matrix(batch.column("numbers"))

    def _keep(self, keys, last: np.ndarray, numbers: np.ndarray) -> None:
        import pyarrow as pa

        from ..operators.long_series import _lists

        batch = pa.record_batch([keys, pa.array(last), _lists(numbers)], schema=self.states)
        self.state.update((batch.serialize().to_pybytes(),))

    def _times(self, table) -> np.ndarray:
        """Milliseconds since 1970."""
        return table.column(self.time).to_numpy(zero_copy_only=False).astype("datetime64[ms]").astype(np.int64)

    def _packed(self, tables: list) -> list[tuple]:
        """Entries of the list for the rows of tables."""
        import pyarrow as pa

        rows = pa.concat_tables(tables)
        at = self._times(rows)
        if len(at) > PACK:
            order = np.argsort(at, kind="stable")
            rows, at = rows.take(pa.array(order)), at[order]
        out = []
        for a in range(0, len(at), PACK):
            batch, own = rows.slice(a, PACK).combine_chunks().to_batches()[0], at[a : a + PACK]
            out.append((int(own.min()), int(own.max()), batch.serialize().to_pybytes()))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pyarrow as pa

        first, held, n = None, [], 0

        def put():
            nonlocal first
            entries = self._packed(held)
            first = min([e[0] for e in entries] + ([] if first is None else [first]))
            self.waiting.appendList(entries)

        for part in rows:
            held.append(pa.Table.from_pandas(part[self.kinds.names], self.schema, preserve_index=False))
            if (n := n + len(part)) >= SLICE:
                put()
                held, n = [], 0
        if n:
            put()
        if first is None:
            return iter(())
        # One timer a group: at its earliest row that waits. A timer fires in the first batch after the watermark has passed it.
        found = self.alarm.get()
        if not found or first < found[0]:
            if found:
                self.handle.deleteTimer(found[0])
            alarm = max(first, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(alarm)
            self.alarm.update((alarm,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        passed = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for entry in self.waiting.get():
            if entry[0] > passed:
                rest.append(tuple(entry))
                continue
            table = pa.Table.from_batches([self._read(entry[2], self.schema)])
            if entry[1] > passed:
                there = pa.array(self._times(table) <= passed)
                rest += self._packed([table.filter(pa.array(self._times(table) > passed))])
                table = table.filter(there)
            ready.append(table)
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        keys, last, numbers = self._known()
        moved = np.zeros(len(keys), bool)
        if ready:
            rows = pa.concat_tables(ready)
            del ready
            # Known keys have their places as codes, new ones follow.
            coded = pa.chunked_array([keys, *rows.column(self.key).chunks]).dictionary_encode().unify_dictionaries()
            own = np.concatenate([c.indices.to_numpy() for c in coded.chunks])[len(keys) :]
            fresh = len(coded.chunk(0).dictionary) - len(keys)
            keys, moved = coded.chunk(0).dictionary, np.concatenate((moved, np.ones(fresh, bool)))
            last = np.concatenate((last, np.full(fresh, np.iinfo(np.int64).min)))
            numbers = np.concatenate((numbers, np.zeros((fresh, self.advance.width))))
            places = places_in_order([own, *[rows.column(c).to_numpy(zero_copy_only=False) for c in (self.time, *self.order)]])
            own = own[places]
            ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            moved[own[ends]] = True
            last[own[ends]] = np.maximum(last[own[ends]], self._times(rows)[places[ends]])
            for a in range(0, len(places), SLICE):
                part = own[a : a + SLICE]
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                numbers[part[first]], out = self.advance.run(numbers[part[first]], first, rows.take(pa.array(places[a : a + SLICE])).to_pandas())
                yield out
        # A key leaves when nothing came for as long as it may be idle, and none of its rows wait.
        stays = moved | (last + self.idle > passed)
        if not stays.all() and rest:
            waits = pa.chunked_array([self._read(e[2], self.schema).column(self.key) for e in rest])
            stays |= pc.is_in(keys, value_set=waits.unique()).to_numpy(zero_copy_only=False)
        alarms = [e[0] for e in rest]
        if stays.any():
            alarms.append(int(last[stays].min()) + self.idle)
            if moved.any() or not stays.all():
                self._keep(keys.filter(pa.array(stays)), last[stays], numbers[stays])
        else:
            self.state.clear()
        if alarms:
            alarm = max(min(alarms), passed + 1)
            self.handle.registerTimer(alarm)
            self.alarm.update((alarm,))
        else:
            self.alarm.clear()


def in_order(rows: DataFrame, key: str, time: str, order: list[str], late: str, advance: Advance, new: str, idle_ms: int = 7 * 86_400_000, groups: int | None = None) -> DataFrame:
    """The stream's rows, once the watermark (`late` behind the latest time) has passed them, with the columns `new` that advance makes.

    Rows without key or time are left out, as no order holds for them. Where keys are many and have few rows each, `groups` deals them into so many
    groups by their hash, else a key is a group; a task holds the rows of a group that a batch sets free. A stream keeps its number of groups for good.
    """
    ship(rows.sparkSession)
    rows = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    out = StructType([*rows.schema.fields, *_parse_datatype_string(new).fields])
    kinds = StructType([StructField(f.name, f.dataType, True) for f in rows.schema])
    processor = InOrder(kinds, key, time, order, advance, idle_ms)
    by = key
    if groups:
        rows, by = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))), "_group"
    return rows.withWatermark(time, late).groupBy(by).transformWithStateInPandas(processor, out, "append", "EventTime")


def running_zscore(value: str, name: str = "z", floor: float = 1e-8) -> Advance:
    """The value's distance from the mean so far in deviations so far; 0 for the first value and for null. State: count and two sums."""

    def run(states, first, rows):
        there = rows[value].notna().to_numpy()
        x = np.where(there, rows[value].to_numpy(float), 0.0)
        sums = np.stack((there, x, x * x)).astype(float)
        for own, a, end in zip(states, first, [*first[1:], len(x)], strict=True):  # a key's sums hold nothing of another's
            sums[:, a:end] = own[:, None] + np.cumsum(sums[:, a:end], axis=1)
        count, total, squares = sums
        some = np.maximum(count, 1)
        mean = total / some
        z = np.where(there & (count > 1), (x - mean) / np.sqrt(np.maximum(squares / some - mean * mean, floor)), 0.0)
        return sums[:, np.append(first[1:], len(x)) - 1].T, rows.assign(**{name: z})

    return Advance(3, run)


def conv_and_scan(x: str, weights: list[float], dt: str, rates: list[float], b: str, c: str, skip: float, name: str = "y", conv: str = "conv") -> Advance:
    """A causal convolution of x, then the selective scan of what it gives, as `operators.long_series.scan` over a table.

    weights[k] counts the value k rows before. State: a ring of the last values of x and one number for each rate; dt, b and c are the row's own.
    Null counts as 0.
    """
    back = len(weights) - 1

    def run(states, first, rows):
        from ..operators.long_series import affine_prefix

        number = lambda column: np.nan_to_num(rows[column].to_numpy(float))

        def lists(column):
            found = rows[column].tolist()
            if all(isinstance(r, np.ndarray) and r.dtype == float for r in found):
                return np.stack(found)
            return np.array([[0.0 if v is None else v for v in r] if r is not None else [0.0] * len(rates) for r in found], float)

        values, counts = number(x), np.diff(np.append(first, len(rows)))
        own = np.repeat(np.arange(len(first)), counts)
        places = np.arange(len(values))
        nth = places - first[own]

        def at(key, start, place):
            """The value at a place of a key's series, whose first `back` places are its ring."""
            ring = states[key, np.minimum(place, max(back - 1, 0))]
            return np.where(place < back, ring, values[np.maximum(start + place - back, 0)])

        u = sum(w * (at(own, places - nth, nth + back - k) if k else values) for k, w in enumerate(weights))
        d = number(dt)[:, None]
        decay, h = affine_prefix(np.exp(d * np.array(rates, float)), d * lists(b) * u[:, None], nth)
        h += decay * states[own, back:]
        y = (lists(c) * h).sum(1) + skip * u
        ring = [at(np.arange(len(first)), first, counts + k) for k in range(back)]
        return np.column_stack([*ring, h[first + counts - 1]]), rows.assign(**{conv: u, name: y})

    return Advance(back + len(rates), run)
