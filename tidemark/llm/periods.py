"""Runs of repetition in word sequences, by power-of-two naming.

Windows of 1, 2, 4, ... words get names (numbers) within their text, equal for equal windows: the names of a length are those of
half of it, paired. A window that occurs once in its text has no name, and no longer window that starts there gets one, so the
lengths end soon where little repeats. A run of period q that is at least 4 * q long has q equal words on a grid of step 2 * q, q
words apart: there the names of the largest window within q words are compared, for all periods of that size at once. What agrees
is extended by the names from the longest down, forwards and backwards, so each extension is exact: no hashes, no suffix array.

One pass over the rows, no shuffle; a task holds the texts of about a megabyte, or one longer text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import ship, slices, words_of

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def names(first: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words that start at each word, -1 for those that occur once in their text or would leave it.

    first: number of each word; text: number of its text, rising.
    """
    n, out = len(first), []
    ends = np.searchsorted(text, text, "right")
    at, pair, length = np.arange(n), text * np.int64(first.max() + 1 if n else 1) + first, 1
    while len(at):
        order = np.argsort(pair, kind="stable")
        new = np.concatenate(([True], pair[order][1:] != pair[order][:-1]))
        named = np.cumsum(new) - 1
        often = np.bincount(named)[named] > 1
        level = np.full(n, -1, np.int32)
        level[at[order[often]]] = named[often]
        if not often.any():
            break
        out.append(level)
        at = np.flatnonzero(level >= 0)
        at = at[at + 2 * length <= ends[at]]
        at = at[level[at + length] >= 0]
        pair = level[at].astype(np.int64) * (n + 1) + level[at + length]
        length *= 2
    return out


def _reach(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, backwards: bool) -> np.ndarray:
    """How many words from a and b on (backwards: before them) are the same."""
    total = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        size, level = 1 << j, levels[j]
        x, y = (a - total - size, b - total - size) if backwards else (a + total, b + total)
        inside = (x >= 0) & (y < len(level))
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        total += size * (inside & (level[x] >= 0) & (level[x] == level[y]))
    return total


def find_runs(first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal run, by start, then period. Words that are equal have equal numbers in `first`;
    text: the number of each word's text, rising; no run lies in two texts.
    """
    levels, found, n = names(first, text), [], len(first)
    for j, level in enumerate(levels):
        periods = np.arange(1 << j, 2 << j)
        places = -(-n // (2 * periods))
        q = np.repeat(periods, places)
        i = 2 * q * (np.arange(len(q)) - np.repeat(np.cumsum(places) - places, places))
        some = i + q < n
        i, q = i[some], q[some]
        same = (level[i] >= 0) & (level[i] == level[i + q])
        found.append((i[same], q[same]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    i, q = (np.concatenate(x) for x in zip(*found))
    start = i - _reach(levels, i, i + q, True)
    length = i + q + _reach(levels, i, i + q, False) - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, length, q = start[long], length[long], q[long]
    # A multiple of a run's period gives the same stretch: keep the smallest.
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    keep = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(q) else np.empty(0, bool)
    start, length, q = start[keep], length[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, n_texts: int) -> list[bytes]:
    """The words of each text joined by one space."""
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out[step + np.repeat(at - before, size)] = data[step + np.repeat(start - before, size)]
    whole, bounds = out.tobytes(), np.searchsorted(text, np.arange(n_texts + 1))
    return [whole[at[a] : at[b - 1] + size[b - 1]] if b > a else b"" for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def periodic_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df with the runs of repetition of each text, and the text without the repeats.

    Words are the stretches between white space of one byte. A run is a stretch of words with smallest period q, at least 6 words
    and four periods long, that the words next to it don't continue. New columns: runs (array of start, length, period; words
    counted from 0; by start, then period), n_runs, start, length, period and exponent_milli of the longest run (the first of equally
    long ones, of these the one of smallest period; null without a run), collapsed (the words joined by a space, without those
    that a run has after its first period). A null or empty text has no runs and is empty when collapsed. Repeated rows stay, other
    columns too, except those that the new ones replace.
    """
    new = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    rows = df.drop(*new)
    at = rows.columns.index(text_col)
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        def number(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            size = end - start
            before = np.cumsum(size) - size
            packed = data[np.arange(int(size.sum())) + np.repeat(start - before, size)]
            bounds = pa.py_buffer(np.append(before, size.sum()).astype(np.int64).tobytes())
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, bounds, pa.py_buffer(packed.tobytes())])
            return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

        for batch in batches:
            for data, offsets, part in slices(batch.column(at), batch):
                start, end, text = words_of(data, offsets)
                s, n, q = find_runs(number(data, start, end), text) if len(start) else (np.empty(0, np.int64),) * 3
                gone = np.zeros(len(start) + 1, np.int64)
                np.add.at(gone, s + q, 1)
                np.add.at(gone, s + n, -1)
                kept = np.cumsum(gone[:-1]) == 0
                texts = _joined(data, start[kept], end[kept], text[kept], part.num_rows)
                of = text[s] if len(s) else s
                first_word = np.searchsorted(text, np.arange(part.num_rows))
                count = np.bincount(of, minlength=part.num_rows)
                bounds = np.concatenate(([0], np.cumsum(count)))
                s = s - first_word[of]
                order = np.lexsort((q, s, -n, of))
                best = order[bounds[:-1][count > 0]]
                none = count == 0

                def of_best(x):
                    out = np.zeros(part.num_rows, np.int64)
                    out[~none] = x[best]
                    return pa.array(out, mask=none)

                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s, n, q)], ["start", "length", "period"])
                made = [pa.array(count, pa.int64()), of_best(s), of_best(n), of_best(q), of_best(1000 * n // q), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, *new])

    kinds = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [kinds]))
