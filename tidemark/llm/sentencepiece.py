"""SentencePiece encoding and decoding by a streaming Viterbi search.

Where no piece can reach across a place (before a space that follows another character, around characters that no longer
piece holds) all paths meet, so texts are cut there. The equal segments of a run of texts are searched once, the short ones of a
run together: a place further in all of them at a time, and all their pieces through the trie a character at a time. A segment
of over 64 characters is read character by character: the search keeps the scores of the last positions only, as many as the
longest piece has characters, and gives out ids as soon as the backpointer paths of all surviving positions meet in one boundary.

The pieces come from a model file, whose path is a parameter; the driver reads it and sends it to the tasks (bounded by the
vocabulary). A unigram model's scores are used as they are. A BPE model's scores are ranks, no log probabilities, so each
piece gets Zipf's, -log(rank + 2.7) less a constant; ids hence differ from BPE merging, decoding is exact all the same.
Characters without a piece fall back to bytes.

A null text has null ids, no tokens, and round_trip true; an empty one has no ids. Repeated rows are encoded alike, one result each. An empty
table gives an empty result. Columns named ids, n_tokens and round_trip are replaced, others are kept.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from math import inf, log

import numpy as np
from pyspark.sql import DataFrame

from .common import slices, tidied

#: Bytes of text whose segments are searched together, and characters of the longest segment that is.
RUN, SHORT = 1 << 19, 64
MARK = "▁"
OTHER, JOINED, SPACE = 0, 1, 2


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]  # with spaces for the mark; byte pieces are empty here
    scores: tuple[float, ...]
    bytes_at: tuple[int, ...]  # ids of the 256 byte pieces

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        pieces = tuple("" if special[i] else model.id_to_piece(i).replace(MARK, " ") for i in range(n))
        by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(by_byte) < 256:
            raise ValueError("the model has no byte fallback")
        normal = [i for i in range(n) if pieces[i]]
        scores = [model.get_score(i) for i in range(n)]
        if all(float(scores[i]).is_integer() for i in normal):  # ranks of merges
            whole = log(sum(1 / (r + 2.7) for r in range(len(normal))))
            for r, i in enumerate(normal):
                scores[i] = -log(r + 2.7) - whole
        low = min(scores[i] for i in normal) - 1.0
        return Vocabulary(pieces, tuple(scores[i] if pieces[i] else low for i in range(n)), tuple(by_byte[b] for b in range(256)))


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.ids = {p: (v.scores[i], i) for i, p in enumerate(v.pieces) if p}
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}
        for p, (piece_score, i) in self.ids.items():
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = (piece_score, (i,))
        self.bytes_at, self.byte_score = v.bytes_at, v.scores[v.bytes_at[0]]
        self.table = [p.encode() for p in v.pieces]
        for b, i in enumerate(v.bytes_at):
            self.table[i] = bytes([b])
        # Characters that longer pieces join to others; a space only ever joins what follows it, or other spaces.
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {" "}
        self.free_spaces = bool(joined) and all(" " not in p.lstrip(" ") for p in self.ids)
        self.kind = np.full(0x110000, OTHER if self.free_spaces else JOINED, np.uint8)
        if self.free_spaces:
            self.kind[[ord(c) for c in joined]] = JOINED
            self.kind[ord(" ")] = SPACE
        # The trie again as arrays: the child of node n by code c is where n * codes + c stands in `edges`, plus 1; those of the root in `roots`.
        alphabet = sorted({c for p in self.ids for c in p})
        codes = {c: i for i, c in enumerate(alphabet, 1)}
        self.codes, self.code = len(codes) + 1, np.zeros(0x110000, np.int32)
        self.code[list(map(ord, alphabet))] = range(1, self.codes)
        nodes, edges = [self.trie], []
        for n, node in enumerate(nodes):  # which grows meanwhile
            below = sorted(c for c in node if c)
            edges.extend(n * self.codes + codes[c] for c in below)
            nodes.extend(node[c] for c in below)
        self.edges, self.roots = np.array([*edges, np.iinfo(np.int64).max]), np.zeros(self.codes, np.int64)
        self.roots[edges[: len(self.trie)]] = range(1, len(self.trie) + 1)
        self.node_score = np.array([n[""][0] if "" in n else -inf for n in nodes])
        self.node_id = np.array([n[""][1][0] if "" in n else -1 for n in nodes], np.int32)
        self.lengths = np.array([*map(len, v.pieces), 1])  # at -1 that of a character in bytes
        self.byte_ids = np.array(v.bytes_at, np.int32)

    def stream(self, characters):
        """Ids in runs, each as soon as it is certain.

        alive: for each position from which a piece may still go on (at most the longest piece's length back), the piece's
        place in the trie, the position's score, and the position. Only these survive; where their paths meet is certain.
        """
        root, byte_score, bytes_at = self.trie, self.byte_score, self.bytes_at
        back: dict[int, tuple[int, tuple[int, ...] | None]] = {}  # position: (where its piece starts, its id)
        at, sure, score = 0, 0, 0.0
        alive = [(root, 0.0, 0)]
        for c in characters:
            at += 1
            best, where, what = score + byte_score * (1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))), at - 1, None
            further = []
            for node, base, start in alive:
                if (child := node.get(c)) is not None:
                    piece = child.get("")
                    if piece is None:
                        further.append((child, base, start))
                        continue
                    if base + piece[0] > best:
                        best, where, what = base + piece[0], start, piece[1]
                    if len(child) > 1:
                        further.append((child, base, start))
            back[at] = (where, what or tuple(bytes_at[b] for b in c.encode("utf-8", "surrogatepass")))
            score = best
            further.append((root, best, at))
            alive = further
            if len(alive) == 1 or at - sure >= 4 * self.longest:
                meeting = at if len(alive) == 1 else self._meeting(back, {p for _, _, p in alive})
                if meeting > sure:
                    yield self._path(back, meeting, sure)
                    for p in range(sure + 1, meeting + 1):
                        del back[p]
                    sure = meeting
        if at > sure:
            yield self._path(back, at, sure)

    @staticmethod
    def _meeting(back: dict, alive: set[int]) -> int:
        """The last boundary that the paths of all surviving positions share."""
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last][0] if last in back else last)
        return alive.pop()

    @staticmethod
    def _path(back: dict, at: int, to: int) -> list[int]:
        runs = []
        while at > to:
            at, ids = back[at]
            runs.append(ids)
        return [i for ids in reversed(runs) for i in ids]

    def _characters(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of UTF-8 bytes, and where each starts."""
        points = data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
        return np.frombuffer(points, np.uint32), np.flatnonzero((data & 0xC0) != 0x80)

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts whose UTF-8 bytes lie end to end in data, the bounds of each text's, and whether they decode to it.

        A text by itself that is longer than two runs goes through in parts: a space after another character starts a segment, as the
        space before a text does, and so takes its place.
        """
        if len(offsets) > 2 or len(data) <= 2 * RUN or not self.free_spaces:
            return self._encode_run(data, offsets)
        spaces = np.flatnonzero((data[1:-1] == 32) & (data[:-2] != 32)) + 1
        parts, a = [], 0
        while a < len(data):
            k = np.searchsorted(spaces, a + RUN)
            b = int(spaces[k]) if k < len(spaces) else len(data)
            parts.append(self._encode_run(data[a:b], np.array([0, b - a])))
            a = b + 1
        ids = np.concatenate([p[0] for p in parts])
        return ids, np.array([0, len(ids)]), np.array([all(p[2][0] for p in parts)])

    def _encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import pyarrow as pa

        full = offsets[1:] > offsets[:-1]
        if not full.any():
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64), ~full
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        points, starts = self._characters(data)
        kind = self.kind[points]
        cut = kind == OTHER
        cut[1:] |= cut[:-1].copy()
        cut[1:] |= (kind[1:] == SPACE) & (kind[:-1] == JOINED)
        cut[np.searchsorted(starts, offsets[:-1][full])] = True
        cuts = np.append(starts[cut], len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        ids, bounds = self._search(pieces.dictionary)
        found = pa.LargeListArray.from_arrays(bounds, ids).take(pieces.indices)
        ids, bounds = found.values.to_numpy(), found.offsets.to_numpy()[np.searchsorted(cuts, offsets)]
        back = pa.array(self.table, pa.large_binary()).take(pa.array(ids))
        at, text = np.frombuffer(back.buffers()[1], np.int64)[bounds], np.frombuffer(back.buffers()[2], np.uint8)
        same = [np.array_equal(text[a:b], data[c:d]) for a, b, c, d in zip(at, at[1:], offsets, offsets[1:])]
        return ids, bounds, np.array(same, bool)

    def _search(self, segments) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, and the bounds of each one's. A character in bytes beats pieces of equal score, a longer piece shorter ones, as in `stream`."""
        at = np.frombuffer(segments.buffers()[1], np.int64)[: len(segments) + 1]
        data = np.frombuffer(segments.buffers()[2], np.uint8)[: at[-1]]
        points, starts = self._characters(data)
        bound = np.searchsorted(starts, at)
        size = np.diff(bound)
        # Places are the bounds of characters, one more to a segment than it has characters; the code at its last is 0, so no piece goes on.
        first = bound[:-1] + np.arange(len(size))
        place = np.arange(len(points)) + np.repeat(np.arange(len(size)), size)
        code, byte, width = (np.zeros(len(points) + len(size), np.int64) for _ in range(3))
        code[place], byte[place], width[place] = self.code[points], starts, np.diff(starts, append=len(data))
        score, step = np.full(len(code), -inf), np.full(len(code), -1, np.int32)  # of the best path to a place: its score, its last piece (-1: bytes)
        score[first] = 0.0
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= SHORT]
        begin, left = first[order], size[order]
        for p in range(left[0] if len(left) else 0):
            start = begin[: np.searchsorted(-left, -p)] + p
            base = score[start]
            plain = base + self.byte_score * width[start]
            wins = np.flatnonzero(plain >= score[start + 1])
            score[start[wins] + 1], step[start[wins] + 1] = plain[wins], -1
            node, to = self.roots[code[start]], start
            goes = np.flatnonzero(node)
            while len(goes):
                node, to, base = node[goes], to[goes] + 1, base[goes]
                reached = base + self.node_score[node]
                wins = np.flatnonzero(reached > score[to])
                score[to[wins]], step[to[wins]] = reached[wins], self.node_id[node[wins]]
                edge = node * self.codes + code[to]
                found = np.searchsorted(self.edges, edge)
                goes, node = np.flatnonzero(self.edges[found] == edge), found + 1
        taken, to = np.zeros(len(code), bool), begin + left
        while len(to):
            taken[to] = True
            to = to - self.lengths[step[to]]
            begin, to = begin[to > begin], to[to > begin]
        where = np.flatnonzero(taken)
        n = np.where(step[where] < 0, width[where - 1], 1)
        ends = np.concatenate(([0], np.cumsum(n)))
        ids, bounds = np.repeat(step[where], n), ends[np.concatenate(([0], np.searchsorted(where, first + size, "right")))]
        nth = np.repeat(byte[where - 1] - ends[:-1], n) + np.arange(len(ids))
        ids[ids < 0] = self.byte_ids[data[nth[ids < 0]]]
        if len(long := np.flatnonzero(size > SHORT)):
            runs = [np.fromiter((i for run in self.stream(segments[int(k)].as_py().decode("utf-8", "surrogatepass")) for i in run), np.int32) for k in long]
            ids = np.insert(ids, np.repeat(bounds[long], [len(r) for r in runs]), np.concatenate(runs))
            more = np.zeros(len(bounds), np.int64)
            more[long + 1] = [len(r) for r in runs]
            bounds = bounds + np.cumsum(more)
        return ids, bounds

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_coders: dict[int, Coder] = {}  # of this worker process: its tables serve one task after another


def coder(vocabulary: Vocabulary) -> Coder:
    key = hash(vocabulary)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The rows of df with ids (array of int), n_tokens, and round_trip: whether decoding gives the text back. One pass, no shuffle."""
    new = ["ids", "n_tokens", "round_trip"]
    rows = df.drop(*new)
    at = rows.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches):
        import pyarrow as pa

        c = coder(sent.value)
        for batch in batches:
            for data, offsets, some in slices(batch.column(at), np.arange(batch.num_rows), RUN):
                part = batch.slice(some[0], len(some))
                flat, bounds, same = c.encode_all(data, offsets)
                nulls = part.column(at).is_null().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(nulls, False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(np.diff(bounds)), pa.array(same)], [*part.schema.names, *new])

    return rows.mapInArrow(tidied(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["ids array<int>, n_tokens long, round_trip boolean"]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows of df with the text of their ids; null for null."""
    rows = df.drop(to)
    at = rows.columns.index(ids_col)
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches):
        import pyarrow as pa

        c = coder(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if i is None else c.decode(i) for i in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, to])

    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{to}` string"]))
