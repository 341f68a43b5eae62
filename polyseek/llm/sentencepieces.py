"""SentencePiece encoding and decoding in numpy, in batches of words of equal length.

Every substring of up to the longest piece's length gets a hash from prefix sums; binary search in the sorted keys of the
pieces tells which substrings are pieces. Viterbi then runs over them: all words of one length advance together over
end positions, and a vectorised maximum over start positions stores the backpointers. That gives the ids of unigram
models, and for every model the number of pieces on the best path. BPE models do not maximise a sum of scores, so their
ids are other ones: all words of a length merge together, each step taking every word's best adjacent pair by a
vectorised maximum, leftmost of equal ones, until none is left. Characters that are no
piece fall back to byte pieces, or to the unknown id where the model has none. Whitespace is escaped, with the dummy
prefix if the model asks for it; texts are not otherwise normalised, so models must have the identity normaliser.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polyseek.llm.anchors import Rolling, mixed
from polyseek.llm.common import column, pieces, small_batches, texts

SPACE = "▁"
#: Words whose ids a task keeps, at most; longer words than LONG merge one by one, with a heap.
KEPT, LONG = 300_000, 200
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A model: pieces, scores, types (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte)."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], bpe: bool, prefix: bool = True):
        self.pieces, self.bpe, self.prefix = pieces, bpe, prefix
        self.scores = np.array(scores, dtype=float)
        usable = [i for i, t in enumerate(types) if t in (1, 4, 5)]
        self.unknown = types.index(2) if 2 in types else 0
        self.bytes_ = {int(pieces[i][3:5], 16): i for i, t in enumerate(types) if t == 6}
        self.index = {pieces[i]: i for i in usable}
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        keys = np.array([self._key(pieces[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, dtype=np.int32)[order]
        #: Leading bits of the keys: most substrings are ruled out by one look here, the others are searched for.
        self.leading = np.zeros(1 << 20, dtype=bool)
        self.leading[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.surface = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else p.replace(SPACE, " ").encode() if t != 2 else b" \xe2\x81\x87 " for p, t in zip(pieces, types, strict=True)]
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        #: Pieces of each known word on its best path.
        self.best: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            m = pb.ModelProto.FromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        p = m.pieces
        return cls([x.piece for x in p], [x.score for x in p], [x.type for x in p], m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)

    def _key(self, piece: str) -> np.uint64:
        return Rolling(mixed(self._codes([piece]) + np.uint64(1)), 8).of(np.array([0]), np.array([len(piece)]))[0]

    def found(self, words: list[str]) -> np.ndarray:
        """For words of one length L: the id of the piece that starts at i and has m characters, -1 if none, as (n, L, m)."""
        n, size = len(words), len(words[0])
        roll = Rolling(mixed(self._codes(words) + np.uint64(1)), 8)
        out = np.full((n, size, min(self.longest, size) + 1), -1, dtype=np.int32)
        base = np.arange(n, dtype=np.int64)[:, None] * size
        for m in range(1, out.shape[2]):
            at = base + np.arange(size - m + 1)
            key = roll.of(at, at + m)
            row, start = np.nonzero(self.leading[(key >> np.uint64(44)).astype(np.int64)])
            key = key[row, start]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[spot] == key
            out[row[on], start[on], m] = self.ids[spot[on]]
        return out

    def _merge(self, found: np.ndarray) -> np.ndarray:
        """Lengths of the segments at their starts, 0 elsewhere, after all BPE merges."""
        n, size, top = found.shape
        out = np.ones((n, size), dtype=np.int64)
        score = np.where(found >= 0, self.scores[np.maximum(found, 0)], -np.inf)
        live = np.arange(n)
        here = np.arange(size)
        while len(live):
            length = out[live]
            after = here + length
            second = np.where(after < size, np.take_along_axis(length, np.minimum(after, size - 1), axis=1), 0)
            both = length + second
            can = (length > 0) & (second > 0) & (both < top)
            value = np.where(can, score[live[:, None], here, np.where(can, both, 0)], -np.inf)
            best = value.argmax(axis=1)
            rows = np.arange(len(live))
            on = value[rows, best] > -np.inf
            live, best, rows = live[on], best[on], rows[on]
            width = length[rows, best]
            out[live, best] += second[rows, best]
            out[live, best + width] = 0
        return out

    def _merge_long(self, word: str) -> list[int]:
        """Segment lengths of one long word: the same merges from a heap of pairs."""
        n = len(word)
        size, prev, nxt = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < n and size[i] + size[j] <= self.longest:
                p = self.index.get(word[i : j + size[j]])
                if p is not None:
                    heapq.heappush(heap, (-self.scores[p], i, size[i], size[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i] += b
            size[j] = 0
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
        return [s for s in size if s]

    def _viterbi(self, found: np.ndarray) -> np.ndarray:
        """Lengths of the segments at their starts on the path of the greatest sum of scores."""
        n, size, top = found.shape
        least = float(self.scores.min()) - 10.0
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((n, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            widths = np.arange(1, min(top - 1, end) + 1)
            ids = found[:, end - widths, widths]
            gain = np.where(ids >= 0, self.scores[np.maximum(ids, 0)], np.where(widths == 1, least, -np.inf))
            total = best[:, end - widths] + gain
            pick = total.argmax(axis=1)
            best[:, end] = total[np.arange(n), pick]
            back[:, end] = widths[pick]
        out = np.zeros((n, size), dtype=np.int64)
        at = np.full(n, size)
        rows = np.arange(n)
        while len(rows):
            width = back[rows, at[rows]]
            at[rows] -= width
            out[rows, at[rows]] = width
            rows = rows[at[rows] > 0]
        return out

    def _spell(self, text: str) -> list[int]:
        p = self.index.get(text)
        if p is not None:
            return [p]
        return [self.bytes_[b] for b in text.encode()] if self.bytes_ else [self.unknown]

    def learn(self, words: Iterable[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for size, group in by.items():
            step = max(1, 400_000 // (size * (min(self.longest, size) + 1)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                found = self.found(part)
                length = self._viterbi(found)
                self.best.update(zip(part, np.count_nonzero(length, axis=1).tolist(), strict=True))
                if self.bpe and size > LONG:
                    for w in part:
                        self._put(w, self._merge_long(w))
                    continue
                if self.bpe:
                    length = self._merge(found)
                rows, starts = np.nonzero(length)
                ids = found[rows, starts, length[rows, starts]]
                bounds = np.searchsorted(rows, np.arange(len(part) + 1))
                plain = ids.astype(self.dtype)
                odd = np.zeros(len(part), dtype=bool)
                odd[rows[ids < 0]] = True
                for i, w in enumerate(part):
                    if odd[i]:
                        self._put(w, length[i][length[i] > 0].tolist())
                    else:
                        self.known[w] = plain[bounds[i] : bounds[i + 1]].tobytes()

    def _put(self, word: str, sizes: list[int]) -> None:
        out, at = [], 0
        for s in sizes:
            out += self._spell(word[at : at + s])
            at += s
        self.known[word] = np.array(out, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian numbers."""
        return [ids for ids, _ in self.encode_with_best(texts)]

    def encode_with_best(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """The ids of each text, and the number of pieces on its path of the greatest sum of scores."""
        mark = SPACE if self.prefix else ""
        # Pieces have the space sign at their beginning only: no merge and no piece crosses from a word into its next.
        cuts = [UNIT.findall(mark + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*cuts).difference(self.known)
        self.learn(fresh)
        get, best = self.known.__getitem__, self.best.__getitem__
        out = [(b"".join(map(get, c)), sum(map(best, c))) for c in cuts]
        if len(self.known) > KEPT:
            for w in fresh:
                del self.known[w], self.best[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype=self.dtype).tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_open: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The process's model of a file, opened once."""
    if path not in _open:
        _open[path] = Pieces.load(path)
    return _open[path]


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of ids as little-endian uint32), round_trip (decoding gives the text again), best_tokens
    (pieces on the path of the greatest sum of scores; for unigram models equal to n_tokens, where no piece falls back to
    bytes) and, if asked for, ids, for each row of docs.

    Null and empty texts have no ids and round_trip true. Repeated rows and null doc_ids stay rows of their own; columns
    other than doc_id and text are not read; an empty table gives an empty one. A word of n characters takes memory in
    proportion to n times the longest piece.
    """

    def made(m: Pieces, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = [t or "" for t in column(batch, "text")]
        got, best = zip(*m.encode_with_best(texts_), strict=True)
        wide = [np.frombuffer(b, dtype=m.dtype).astype("<u4") for b in got]
        out = {
            "doc_id": batch.column(0), "n_tokens": [len(x) for x in wide], "ids_crc32": [zlib.crc32(x.tobytes()) for x in wide],
            "round_trip": [m.decode(b) == t for b, t in zip(got, texts_, strict=True)], "best_tokens": list(best),
        } | ({"ids": pa.array([x.astype(np.int32) for x in wide], pa.list_(pa.int32()))} if ids else {})
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        try:
            for batch in batches:
                for piece in pieces(batch, 2 << 20):
                    yield made(m, piece)
        finally:  # workers live on: the next stage needs the memory
            m.known.clear()
            m.best.clear()

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, best_tokens long" + ", ids array<int>" * ids)
