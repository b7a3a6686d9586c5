"""Byte-pair encoding with forced boundaries, and decoding.

A pair of bytes that stands inside no entry of the vocabulary is a certain cut: no merge crosses it, whatever stands around it.
Texts are cut there and where the vocabulary's own splitting of text into pieces cuts, both found over whole arrays of bytes;
each fragment is merged by itself, most of them once for all texts of a task, and the ids are put together in order.
One pass over the rows, no shuffle; a task holds about a megabyte of text at a time, whatever the length of a text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import ship, slices

#: Fragments and their ids that a worker remembers, and the longest of them in bytes.
MEMO, MEMO_BYTES = 1 << 18, 64
#: Texts from this length on are encoded in pieces, in bytes.
PIECE = 1 << 21

# The pieces that text falls into before any merge.
# An apostrophe with one of these endings is a piece of its own.
ENDINGS_OF_ONE, ENDINGS_OF_TWO = "stmd", ("re", "ve", "ll")
# Code points that became letters and numbers in version 16.0 of the Unicode standard; Python's tables may be older.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Here a text may be taken apart before it is looked at: after visible ASCII before white space, or after an ideograph before
#: anything of ASCII that comes before the letters.
_SAFE = re.compile(rb"[!-~](?=[\t-\r ])|[\xe4-\xe9][\x80-\xbf]{2}(?=[\x00-@])")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself where it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def character_kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for each code point; white space by the Unicode property, to which U+001C to U+001F don't belong."""
    kinds = np.zeros(0x110000, np.uint8)
    letters = {"Lu", "Ll", "Lt", "Lm", "Lo"}
    for cp in range(0x40000):  # beyond, nothing is a letter, a number or a space
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in letters:
            kinds[cp] = LETTER
        elif kind[0] == "N":
            kinds[cp] = NUMBER
        elif c.isspace() and not 0x1C <= cp <= 0x1F:
            kinds[cp] = SPACE
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    return kinds


@dataclass
class Vocabulary:
    """What a vocabulary file says: the bytes of each id, the pair and result of each merge in order, special tokens."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    special: dict[bytes, int]
    key: str = field(default="")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        model, added = said["model"], {t["content"]: t["id"] for t in said["added_tokens"]}
        tokens = [b""] * (1 + max([*model["vocab"].values(), *added.values()]))
        for t, i in model["vocab"].items():
            tokens[i] = bytes(byte_of[c] for c in t)
        merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
        for t, i in added.items():
            tokens[i] = t.encode()
        return cls(tokens, merges, {t.encode(): i for t, i in added.items()}, path)


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.special = v.special
        self.by_byte = [0] * 256
        inside = np.zeros((256, 256), bool)
        for i, t in enumerate(v.tokens):
            if i in v.special.values():
                continue
            if len(t) == 1:
                self.by_byte[t[0]] = i
            elif t:
                b = np.frombuffer(t, np.uint8)
                inside[b[:-1], b[1:]] = True
        #: By first byte * 256 + second: no token holds the pair.
        self.forced = ~inside.ravel()
        self.ranks = {(a, b): (rank, to) for rank, (a, b, to) in enumerate(v.merges)}
        self.kinds = character_kinds()
        #: Ids of a fragment as the bytes of 32-bit numbers.
        self.memo: dict[bytes, bytes] = {}
        self.pairs = np.array([a * len(v.tokens) + b for a, b, _ in v.merges], np.int64)
        self.by_pair = np.argsort(self.pairs)
        self.pairs, self.results = self.pairs[self.by_pair], np.array([to for _, _, to in v.merges], np.int32)
        #: Whether what a merge makes is used by later merges only: then all of a fragment's pairs of lowest rank can merge at once.
        made = np.full(len(v.tokens), -1)
        made[self.results] = np.arange(len(v.merges))
        self.ordered = len(set(self.results.tolist())) == len(v.merges) and all(made[a] < rank and made[b] < rank for rank, (a, b, _) in enumerate(v.merges))
        self.lengths = np.array([len(t) for t in v.tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.spelled = np.frombuffer(b"".join(v.tokens), np.uint8)

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the merge of lowest rank first, of equal ones the leftmost, until none is left."""
        if fragment in self.special:
            return [self.special[fragment]]
        ids = [self.by_byte[b] for b in fragment]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[pair], at, *pair) for at in range(n - 1) if (pair := (ids[at], ids[at + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, to, at, left, right = heapq.heappop(heap)
            follows = after[at]
            if ids[at] != left or follows >= n or ids[follows] != right:
                continue  # one of the two has become part of another token
            ids[at], ids[follows] = to, -1
            after[at] = beyond = after[follows]
            if beyond < n:
                before[beyond] = at
                if (pair := (to, ids[beyond])) in ranks:
                    heapq.heappush(heap, (*ranks[pair], at, *pair))
            if (ahead := before[at]) >= 0 and (pair := (ids[ahead], to)) in ranks:
                heapq.heappush(heap, (*ranks[pair], ahead, *pair))
        return [i for i in ids if i >= 0]

    def merge_all(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment, as the bytes of 32-bit numbers: short ones together, a merge of each in every round."""
        out: list[bytes] = [b""] * len(fragments)
        short = [i for i, f in enumerate(fragments) if self.ordered and len(f) <= MEMO_BYTES and f not in self.special]
        for i in set(range(len(fragments))).difference(short):
            out[i] = np.array(self.merge(fragments[i]), np.int32).tobytes()
        sizes = np.array([len(fragments[i]) for i in short], np.int64)
        ids = np.array(self.by_byte, np.int32)[np.frombuffer(b"".join([fragments[i] for i in short]), np.uint8)]
        owner, never = np.repeat(np.array(short, np.int64), sizes), len(self.pairs)
        while len(ids):
            pair = ids[:-1].astype(np.int64) * len(self.lengths) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), never - 1)
            rank = np.full(len(ids), never)
            rank[:-1] = np.where((self.pairs[at] == pair) & (owner[:-1] == owner[1:]), self.by_pair[at], never)
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(heads, len(ids)))
            best = np.minimum.reduceat(rank, heads)
            done = best == never
            if done.any():
                data, ends = ids.tobytes(), (heads + sizes).tolist()
                for h in np.flatnonzero(done).tolist():
                    out[owner[heads[h]]] = data[4 * heads[h] : 4 * ends[h]]
            each = np.repeat(best, sizes)
            hit = (rank == each) & (each < never)
            # Of pairs that overlap (a run of one token) every second one merges, from the left.
            places = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), places, 0))
            hit &= (places - run) % 2 == 0
            ids[hit] = self.results[rank[hit]]
            keep = ~np.repeat(done, sizes)
            keep[1:] &= ~hit[:-1]
            ids, owner = ids[keep], owner[keep]
        return out

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a piece of the pattern starts at each byte. bounds: bytes where a text or a special token starts or ends."""
        text = data.tobytes().decode()
        if len(text) == len(data):
            cp, at = data, None
        else:
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)
            bounds = np.searchsorted(at, bounds)
        n = len(cp)
        kind = np.full(n + 3, SPACE, np.uint8)
        kind[:n] = self.kinds[cp]
        char = np.zeros(n + 3, np.uint32)
        char[:n] = cp
        first = np.zeros(n + 3, bool)
        first[bounds] = True
        first[n:] = True
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # Of a run of spaces before something else the last stands alone, or goes with what follows if it is U+0020.
        last = np.flatnonzero((kind[:n] == SPACE) & (kind[1 : n + 1] != SPACE) & ~first[1 : n + 1])
        start[last] = True
        start[last[char[last] == 32] + 1] = False
        mark = np.flatnonzero((char[:n] == 39) & start[:n] & ~first[1 : n + 1])
        one = mark[np.isin(char[mark + 1], [ord(c) for c in ENDINGS_OF_ONE])]
        start[one + 1] = False
        start[one + 2] = True
        for a, b in ENDINGS_OF_TWO:
            two = mark[(char[mark + 1] == ord(a)) & (char[mark + 2] == ord(b)) & ~first[mark + 2]]
            start[two + 1] = False
            start[two + 3] = True
        if at is None:
            return start[:n]
        out = np.zeros(len(data), bool)
        out[at] = start[:n]
        return out

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes at which fragments start, those of the texts among them."""
        text = data.tobytes()
        marked = [(m.start(), m.end()) for t in self.special for m in re.finditer(re.escape(t), text)]
        ends = set(offsets[1:-1].tolist())
        marked = [(a, b) for a, b in marked if ends.isdisjoint(range(a + 1, b))] if marked else []  # no token lies across two texts
        bounds = np.unique(np.concatenate((offsets, np.array(marked, np.int64).ravel())).astype(np.int64))
        cut = self.pieces(data, bounds[bounds < len(data)])
        cut[1:] |= self.forced[data[:-1].astype(np.uint16) * 256 + data[1:]]
        for a, b in marked:
            cut[a + 1 : b] = False
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie end to end in data, and how many of them each text has."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts = self.cuts(data, offsets)
        text, places = data.tobytes(), [*starts.tolist(), len(data)]
        fragments = [text[a:b] for a, b in zip(places, places[1:])]
        wanted = set(fragments)
        new = [f for f in wanted if f not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(wanted)
        self.memo.update(zip(new, self.merge_all(new)))
        coded = list(map(self.memo.__getitem__, fragments))
        for f in new:
            if len(f) > MEMO_BYTES:
                del self.memo[f]
        found = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        upto = np.concatenate(([0], np.cumsum(found)))
        return np.frombuffer(b"".join(coded), np.int32), np.diff(upto[np.searchsorted(starts, offsets)])

    def encode_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text of any length, some megabytes at a time."""
        text, at, out = data.tobytes(), 0, []
        while at < len(text):
            safe = _SAFE.search(text, at + PIECE)
            to = safe.end() if safe else len(text)
            out.append(self.encode(data[at:to], np.array([0, to - at]))[0])
            at = to
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that runs of ids stand for; counts: how many ids each run has."""
        lengths = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        places = np.arange(upto[-1]) + np.repeat(self.starts[ids] - upto[:-1], lengths)
        data = self.spelled[places].tobytes()
        ends = upto[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


_coders: dict[str, Coder] = {}  # of this worker process; a memo serves one task after another


def _coder(vocabulary: Vocabulary) -> Coder:
    if vocabulary.key not in _coders:
        _coders.clear()
        _coders[vocabulary.key] = Coder(vocabulary)
    return _coders[vocabulary.key]


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with the replacement character for bytes that aren't UTF-8."""
    try:
        data.tobytes().decode()
        return data, offsets
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def _schema(rows: DataFrame, *new: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + list(new))


def encode(df: DataFrame, path: str, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """The rows of df with ids (array of int), and with `decoded` a column of that name: what those ids decode to.

    path: a vocabulary file of byte-level BPE on the driver, sent to the tasks once. Strings of special tokens in a text become
    those tokens; none is added. A null text has null ids, an empty one no ids. Repeated rows stay, other columns too, except
    those that the new ones replace; null in any of them is nothing special.
    """
    new = ["ids"] + ([decoded] if decoded else [])
    rows = df.drop(*new)
    at = rows.columns.index(text_col)
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches):
        import pyarrow as pa

        c = _coder(sent.value)
        for batch in batches:
            for data, offsets, part in slices(batch.column(at), batch):
                data, offsets = _valid(data, offsets)
                if len(offsets) == 2 and len(data) > 2 * PIECE:
                    ids = c.encode_long(data)
                    counts = np.array([len(ids)])
                else:
                    ids, counts = c.encode(data, offsets)
                none = part.column(at).is_null().to_numpy(zero_copy_only=False)
                bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.append(none, False))
                made = [pa.ListArray.from_arrays(bounds, pa.array(ids))]
                if decoded:
                    texts = [t.decode("utf-8", "replace") for t in c.decode(ids, counts)]
                    made.append(pa.array(texts, pa.string(), mask=none))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *new])

    return rows.mapInArrow(run, _schema(rows, "ids array<int>", *([f"`{decoded}` string"] if decoded else [])))


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows of df with the text of their ids, special tokens spelled out; null for null. Bytes that make no UTF-8 become
    the replacement character. An id that isn't in the vocabulary, and a null among the ids, is an error.
    """
    rows = df.drop(to)
    at = rows.columns.index(ids_col)
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        c = _coder(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                column = part.column(at)
                counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                texts = [t.decode("utf-8", "replace") for t in c.decode(ids, counts)]
                none = column.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=none)], [*part.schema.names, to])

    return rows.mapInArrow(run, _schema(rows, f"`{to}` string"))
