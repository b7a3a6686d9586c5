"""Running state by key over a stream: the cumulative z-score, whose count and sums live in the state store, and a scan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.shipping import ship

#: Rows that are worked on and given out at once.
SLICE = 65_536


def places_in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Where the rows stand when sorted by the columns, nulls last, rows alike as they came."""
    import pandas as pd

    def comparable(c):
        if c.dtype != object:
            return c
        codes = pd.Categorical(c).codes
        return np.where(codes < 0, np.iinfo(codes.dtype).max, codes)

    return np.lexsort([comparable(c) for c in reversed(columns)])


def _running(rows: DataFrame, key: str, order: list[str], value: str, advance: Callable, name: str, state: str) -> DataFrame:
    """Rows of the key, order and value columns with `name`, which advance makes: (numbers so far or None, values) to (numbers, results).

    Within a micro-batch a key's rows are put in order. They are held as bare arrays of the order and the value, and go through and out a slice at a time.
    """
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    columns = list(dict.fromkeys([key, *order, value]))

    def update(k, parts, state):
        import pandas as pd

        held, own = {c: [] for c in columns if c != key or c in order}, None
        for part in parts:
            own = part[key].iloc[:1] if own is None else own
            for c, pieces in held.items():
                pieces.append(part[c].to_numpy())
        # A column's pieces go before the next column is put together.
        whole = {c: np.concatenate(held.pop(c)) for c in list(held)}
        places = places_in_order([whole[c] for c in order])
        numbers = state.get if state.exists else None
        for a in range(0, len(places), SLICE):
            at = places[a : a + SLICE]
            out = pd.DataFrame({c: whole[c][at] if c in whole else own.take(np.zeros(len(at), int)).to_numpy() for c in columns})
            numbers, out[name] = advance(numbers, out[value])
            state.update(numbers)
            yield out

    out = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"{name} double"])
    return rows.select(*columns).groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_cumulative_zscore(rows: DataFrame, key: str, order: list[str], value: str, floor: float = 1e-8) -> DataFrame:
    """Rows of the stream's key, order and value columns with z, the value's distance from the mean so far in deviations so far.

    Within a micro-batch a key's rows are put in order; batches follow one another as they come, so late rows count
    from their batch on. The first value of a key, and null values, have z = 0. State: three numbers a key.
    """

    def advance(numbers, values):
        n, total, squares = numbers or (0, 0.0, 0.0)
        there = values.notna().to_numpy()
        x = np.where(there, values.to_numpy(float), 0.0)
        count, sums, sq = n + np.cumsum(there), total + np.cumsum(x), squares + np.cumsum(x * x)
        some = np.maximum(count, 1)
        mean = sums / some
        z = np.where(there & (count > 1), (x - mean) / np.sqrt(np.maximum(sq / some - mean * mean, floor)), 0.0)
        return (int(count[-1]), float(sums[-1]), float(sq[-1])), z

    return _running(rows, key, order, value, advance, "z", "n bigint, total double, squares double")


def stream_scan(rows: DataFrame, key: str, order: list[str], value: str, decay: float) -> DataFrame:
    """Rows of the stream's key, order and value columns with h = exp(-decay) * h + value. Null values count as 0, and h is null until
    a key's first value. State: one number a key.
    """

    def advance(numbers, values):
        import math

        h, out, keep = numbers[0] if numbers else None, [], math.exp(-decay)
        for v, there in zip(values.fillna(0.0).tolist(), values.notna().tolist(), strict=True):
            if there or h is not None:
                h = keep * (h or 0.0) + v
            out.append(h)
        return (h,), out

    return _running(rows, key, order, value, advance, "h", "h double")
