"""Token vectors from an encoder: the interface that a model plugs into, batch by batch, and an encoder without a model.

An encoder takes a list of token lists and gives for each an array of hidden vectors, a row for each token. ``encode``
projects these, drops masked tokens and normalises what is left. Encoders are made once in each worker. One whose hidden
vectors are linear in those of distinct tokens may have ``through(layer)``, an encoder of the projected vectors: the layer is
then applied to distinct tokens and no hidden vector of a token in its place is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from polyseek.operators.pairs import Runs
from polyseek.operators.text import PUNCTUATION

HIDDEN, WIDTH = 768, 128
#: Documents that an encoder gets at once.
BATCH = 64

Encoder = Callable[[list[list[str]]], list[np.ndarray]]


def projection(hidden: int = HIDDEN, width: int = WIDTH, seed: int = 7) -> np.ndarray:
    """A random linear layer, the same in every worker."""
    return np.random.default_rng(seed).normal(size=(hidden, width)) / np.sqrt(hidden)


#: Bytes of distinct tokens' vectors, and pairs of letters, that a worker keeps from batch to batch.
KEPT_BYTES, KEPT_PAIRS = 32 << 20, 1 << 18


class HashedEncoder:
    """Hidden vectors from a token's letter pairs and, half as strong, those of its neighbours: no model, but tokens that
    look alike and stand alike come out alike. Distinct tokens are hashed once and kept while ``KEPT_BYTES`` allow it."""

    def __init__(self, hidden: int = HIDDEN, layer: np.ndarray | None = None):
        self.hidden = hidden
        layer = np.eye(hidden) if layer is None else layer
        self.width = layer.shape[1]
        self.signed = np.concatenate([layer, -layer])  # what a pair of letters adds, by its hash
        self.pair: dict[str, int] = {}
        self.at: dict[str, int] = {}
        self.own = np.zeros((0, self.width))

    def through(self, layer: np.ndarray) -> HashedEncoder:
        return HashedEncoder(self.hidden, layer)

    def _pairs(self, token: str) -> list[int]:
        """Rows of ``signed`` whose sum is the token's vector."""
        marked, out = f"<{token}>", []
        for a in range(len(marked) - 1):
            p = marked[a : a + 2]
            i = self.pair.get(p)
            if i is None:
                h = xxhash.xxh64_intdigest(p.encode())
                i = h % self.hidden + (0 if h >> 63 else self.hidden)
                if len(self.pair) < KEPT_PAIRS:
                    self.pair[p] = i
            out.append(i)
        return out

    def _vectors(self, names: set[str]) -> None:
        """Vectors of new names behind those that are kept; the kept ones go when there are too many."""
        if 8 * self.width * (len(self.at) + len(names)) > KEPT_BYTES:
            self.at, self.own = {}, np.zeros((0, self.width))
        fresh, n = sorted(t for t in names if t not in self.at), len(self.at)
        if n + len(fresh) > len(self.own):
            more = np.zeros((max(n + len(fresh), 2 * n), self.width))
            more[:n] = self.own[:n]
            self.own = more
        for s in range(0, len(fresh), 256):
            rows = [self._pairs(t) for t in fresh[s : s + 256]]
            ends = np.cumsum([len(r) for r in rows])
            each = self.signed[np.concatenate(rows)]
            self.own[n + s : n + s + len(rows)] = Runs(np.append(0, ends[:-1]), len(each)).reduce(np.add, each)
        self.at.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        self._vectors({t for words in texts for t in words})
        out = []
        for words in texts:
            x = self.own[[self.at[t] for t in words]] if words else np.zeros((0, self.width))
            y = x.copy()
            y[1:] += 0.5 * x[:-1]
            y[:-1] += 0.5 * x[1:]
            out.append(y)
        return out


def hashed_encoder(hidden: int = HIDDEN) -> Encoder:
    return HashedEncoder(hidden)


def encode(docs: DataFrame, key: str, words: Column, make: Callable[[], Encoder] = hashed_encoder, width: int = WIDTH, skip: str = PUNCTUATION, length: str | None = None) -> DataFrame:
    """(key, pos, v, and with ``length`` a column of that name with the length of v): a unit vector for each token of each row of docs, without tokens that are a single sign of ``skip``.
    pos counts all tokens from 0; a vector of length 0 stays as it is; rows without tokens give none."""
    kind = docs.schema[key].dataType.simpleString()
    signs = frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, layer = make(), projection(width=width)
        if through := getattr(encoder, "through", None):
            encoder, layer = through(layer), None
        for whole in batches:
            for s in range(0, whole.num_rows, BATCH):
                batch = whole.slice(s, BATCH)
                texts = [w or [] for w in batch.column(1).to_pylist()]
                kept = [[i for i, t in enumerate(w) if t not in signs] for w in texts]
                hidden = encoder(texts)
                v = np.concatenate([h[k] for h, k in zip(hidden, kept, strict=True)])
                v = v if layer is None else v @ layer
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                row = np.repeat(np.arange(len(texts)), [len(k) for k in kept])
                ends = np.arange(len(v) + 1, dtype=np.int32) * width
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))
                columns = [batch.column(0).take(pa.array(row)), pa.array(np.concatenate([np.array(k, dtype=np.int32) for k in kept])), vectors]
                if length is not None:
                    columns.append(pa.array(np.linalg.norm(v, axis=1)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "pos", "v", *([] if length is None else [length])]
    return docs.select(key, words.alias("w")).mapInArrow(run, f"`{key}` {kind}, pos int, v array<double>" + ("" if length is None else f", `{length}` double"))
