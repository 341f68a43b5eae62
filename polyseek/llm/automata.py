"""Exact removal of passages repeated from earlier documents, by suffix automata of reference shards.

A window is ``length`` consecutive words; a word goes if a window that covers it also starts in a document of smaller
doc_id. Anchors (anchors.py) only filter and route: windows are grouped by their anchor, so equal windows are in one group,
and groups within one document go. The distinct stretches (all words of the windows with one anchor) of the others, each
with its least doc_id, are the reference passages. Every removal is decided by an automaton's matching statistics: at each
position of a streamed text the state of its last ``length`` words tells the least document that has them.

- References of up to ``BROADCAST`` bytes in all make one automaton, which is broadcast; documents stream through it.
- Larger references are split into shards of whole groups. A shard's stretches can only match inside it, so each goes to
  one task, which builds the automaton of at most about ``SHARD`` passages, streams its stretches through it and returns
  the least document of each window; documents take these from the stretches that they have.

A group of more than ``HOT`` distinct stretches (one passage in very many surroundings) would be too much for one task: the
windows of its distinct stretches become references of their own, equal ones collapse to their least document before the
shuffle, and each stretch puts its windows' answers together again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.anchors import BYTES, Rolling, anchored
from polyseek.llm.common import arrow, column, numbered, parts, saved, small_batches

LENGTH = 50
ANCHOR = 25
HOT = 256
#: Bytes of passages that are broadcast as one automaton, at most.
BROADCAST = 1 << 20
#: Passages of one automaton, at least, where a task has that many.
SHARD = 1000
#: Words of a text that are hashed at a time.
SEGMENT = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ROWS = "uid long, doc_id long, h long, c long, first int, last int"


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in UTF-8 bytes."""
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def word_values(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, computed over runs of words."""
    out = np.empty(len(start), dtype=np.uint64)
    for s in range(0, len(start), SEGMENT):
        a, b = start[s : s + SEGMENT], end[s : s + SEGMENT]
        out[s : s + SEGMENT] = Rolling(BYTES[data[a[0] : b[-1]]], 4).of(a - a[0], b - a[0])
    return out


def window_rows(packed: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """A row for each run of windows with one anchor: uid, doc_id, h, c and first and last window, in words."""

    def rows(sequences: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(v) for *_, v in sequences], dtype=np.int64)])
        x = anchored(np.concatenate([v for *_, v in sequences]), offsets, length, k)
        uid, doc, shift = (np.array([s[i] for s in sequences], dtype=np.int64)[x["seq"]] for i in range(3))
        shift -= offsets[x["seq"]]
        return pa.RecordBatch.from_pydict({
            "uid": uid, "doc_id": doc, "h": x["h"].view(np.int64), "c": x["c"].view(np.int64),
            "first": (x["first"] + shift).astype(np.int32), "last": (x["last"] + shift).astype(np.int32),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            for uid, doc, z in zip(*(column(batch, n) for n in ("uid", "doc_id", "z")), strict=True):
                data = np.frombuffer(unpack(z), dtype=np.uint8)
                start, end = word_spans(data)
                for at in range(0, max(len(start) - length + 1, 0), SEGMENT):
                    p = slice(at, at + SEGMENT + length - 1)
                    held.append((uid, doc, at, word_values(data, start[p], end[p])))
                    size += len(held[-1][3])
                    if size >= SEGMENT // 4:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)

    return packed.where("doc_id is not null").select("uid", "doc_id", "z").mapInArrow(run, ROWS)


class SuffixAutomaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for i, w in enumerate(words):
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:  # an earlier sequence went the same way
                last = q
                continue
            if q is not None:
                last = self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            size.append(i + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = nxt[p][w]
                link.append(0)
                link[cur] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w: object, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def states(self, words: list, length: int) -> list[int]:
        """Matching statistics of a sequence: for each end position the state of its last ``length`` words, -1 if they
        do not occur."""
        nxt, link, size = self.next, self.link, self.size
        at, have, out = 0, 0, []
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                have = size[at]
            if w in nxt[at]:
                at = nxt[at][w]
                have += 1
            v = at
            if have >= length:
                while size[link[v]] >= length:
                    v = link[v]
                out.append(v)
            else:
                out.append(-1)
        return out[length - 1 :]


def least_documents(passages: list[tuple[list, int]], length: int) -> list[list[int]]:
    """For each (words, doc_id) the least doc_id over all passages for each of its windows."""
    sam, least = _reference(passages, length)
    return [[least[s] for s in sam.states(words, length)] for words, _ in passages]


def _reference(passages: list[tuple[list, int]], length: int) -> tuple[SuffixAutomaton, dict[int, int]]:
    """The automaton of passages, and the least doc_id at the state of each of their windows."""
    sam = SuffixAutomaton()
    for words, _ in passages:
        sam.add(words)
    least: dict[int, int] = {}
    for words, doc in passages:
        for s in sam.states(words, length):
            if least.get(s, doc) >= doc:
                least[s] = doc
    return sam, least


def _shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids: dict[bytes, int] = {}
            got = least_documents([([ids.setdefault(w, len(ids)) for w in words.split()], m) for _, _, m, words in held], length)
            return pa.RecordBatch.from_pydict({"h": pa.array([r[0] for r in held], pa.int64()), "c": pa.array([r[1] for r in held], pa.int64()), "mins": pa.array(got, pa.list_(pa.int64()))})

        for batch in batches:
            for row in zip(*(column(batch, n) for n in ("h", "c", "m", "words")), strict=True):
                if len(held) >= SHARD and row[0] != held[-1][0]:
                    yield flush()
                    held.clear()
                held.append(row)
        if held:
            yield flush()

    return run


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose h stands in several documents."""
    several = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    return saved(rows.join(saved(several), "h", "left_semi"))


def references(rows: DataFrame) -> DataFrame:
    """The distinct stretches (h, c) with their least document m and where they stand there: uid, first, last."""
    least = rows.groupBy("h", "c").agg(F.min(F.struct("doc_id", "uid", "first", "last")).alias("r"))
    return saved(least.select("h", "c", F.col("r.doc_id").alias("m"), "r.uid", "r.first", "r.last"))


def passages(packed: DataFrame, want: DataFrame, length: int) -> DataFrame:
    """h, c, m and the words of each reference, joined by spaces."""
    want = want.groupBy("uid").agg(F.collect_list(F.struct("h", "c", "m", "first", "last")).alias("runs"))

    def run(batch: pa.RecordBatch) -> dict | None:
        unpack = zstandard.ZstdDecompressor().decompress
        out = []
        for z, runs in zip(column(batch, "z"), column(batch, "runs"), strict=True):
            words = unpack(z).split()
            out += [(r["h"], r["c"], r["m"], b" ".join(words[r["first"] : r["last"] + length])) for r in runs]
        return {n: pa.array(v, pa.binary() if n == "words" else pa.int64()) for n, v in zip(("h", "c", "m", "words"), zip(*out, strict=True), strict=True)} if out else None

    return saved(arrow(packed.join(want, "uid").select("z", "runs"), run, "h long, c long, m long, words binary", most=1 << 20))


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of true values."""
    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return turn[::2], turn[1::2] - 1


def streamed(packed: DataFrame, rows: DataFrame, text: DataFrame, length: int) -> DataFrame:
    """(uid, first, last) of windows that also start in an earlier document: one broadcast automaton of all references,
    through which the documents of rows stream."""
    ids: dict[bytes, int] = {}
    held = [([ids.setdefault(w, len(ids)) for w in r.words.split()], r.m) for r in text.orderBy("m", "h", "c").collect()]  # at most BROADCAST bytes
    shard = packed.sparkSession.sparkContext.broadcast((ids, *_reference(held, length)))

    def run(batch: pa.RecordBatch) -> dict:
        ids, sam, least = shard.value
        unpack = zstandard.ZstdDecompressor().decompress
        uid, first, last = [], [], []
        for u, doc, z in zip(*(column(batch, n) for n in ("uid", "doc_id", "z")), strict=True):
            states = sam.states([ids.get(w, -1) for w in unpack(z).split()], length)
            a, b = _runs(np.array([least.get(s, doc) < doc for s in states], dtype=bool))
            uid += [u] * len(a)
            first += a.tolist()
            last += b.tolist()
        return {"uid": pa.array(uid, pa.int64()), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())}

    docs = packed.select("uid", "doc_id", "z").join(rows.select("uid").distinct(), "uid", "left_semi")
    return arrow(docs, run, "uid long, first int, last int", most=1 << 20)


def single_windows(text: DataFrame, length: int) -> DataFrame:
    """h, c, m, j, w, v, words: each window j of references (h, c, m, words), w and v being hashes of its words."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("h", "c", "m", "j", "w", "v", "words")}
        for h, c, m, raw in zip(*(column(batch, n) for n in ("h", "c", "m", "words")), strict=True):
            data = np.frombuffer(raw, dtype=np.uint8)
            start, end = word_spans(data)
            p = np.arange(len(start) - length + 1)
            first, last = start[p], end[p + length - 1]
            for n, x in (("h", np.full(len(p), h)), ("c", np.full(len(p), c)), ("m", np.full(len(p), m)), ("j", p), *((n, Rolling(BYTES[data], k).of(first, last).view(np.int64)) for n, k in (("w", 5), ("v", 6)))):
                out[n] += x.tolist()
            out["words"] += [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return {n: pa.array(x, pa.binary() if n == "words" else pa.int64()) for n, x in out.items()}

    return saved(arrow(text.select("h", "c", "m", "words"), run, "h long, c long, m long, j long, w long, v long, words binary", most=1 << 19))


def sharded(rows: DataFrame, text: DataFrame, length: int) -> DataFrame:
    """(uid, first, last) as streamed() gives them, by an automaton for each shard of references."""
    n = parts(rows.sparkSession)
    hot = saved(text.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"))
    windows = None
    if not hot.isEmpty():
        windows = single_windows(text.join(hot, "h", "left_semi"), length)
        own = windows.groupBy("w", "v").agg(F.min(F.struct("m", "words")).alias("r")).select(F.col("w").alias("h"), F.col("v").alias("c"), "r.m", "r.words")
        text = text.join(hot, "h", "left_anti").select("h", "c", "m", "words").union(own)
    least = saved(text.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_shards(length), "h long, c long, mins array<bigint>"))
    if windows is not None:
        answers = windows.select("h", "c", "j", "w", "v").join(least.select(F.col("h").alias("w"), F.col("c").alias("v"), F.get("mins", F.lit(0)).alias("l")), ["w", "v"])
        whole = answers.groupBy("h", "c").agg(F.sort_array(F.collect_list(F.struct("j", "l"))).alias("x")).select("h", "c", F.col("x.l").alias("mins"))
        least = least.unionByName(whole)
    hit = rows.join(least, ["h", "c"]).where(F.array_min("mins") < F.col("doc_id"))

    def run(batch: pa.RecordBatch) -> dict:
        uid, first, last = [], [], []
        for u, d, f, z, mins in zip(*(column(batch, n) for n in ("uid", "doc_id", "first", "last", "mins")), strict=True):
            a, b = _runs(np.array(mins[: z - f + 1]) < d)
            uid += [u] * len(a)
            first += (f + a).tolist()
            last += (f + b).tolist()
        return {"uid": pa.array(uid, pa.int64()), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())}

    return arrow(hit.select("uid", "doc_id", "first", "last", "mins"), run, "uid long, first int, last int")


def repeats(packed: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(uid, spans): first and last starts, in words, of windows that also start in a document of smaller doc_id."""
    small_batches(packed.sparkSession)
    rows = shared(saved(window_rows(packed, length, k)))
    found = references(rows)
    text = passages(packed, found, length)
    size = text.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    spans = streamed(packed, rows, text, length) if size <= BROADCAST else sharded(rows, text, length)
    return spans.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, kept: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (binary).

    Windows are judged on the input; kept words are joined by one space. Null texts have no words. Rows of equal doc_id
    are not smaller than each other; a null doc_id is smaller than none and has no smaller one: its row stays whole.
    Columns other than doc_id and text are not read. An empty table gives an empty one.
    """
    packed = numbered(docs)
    spans = repeats(packed, length, k)

    def run(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        total, gone, left = [], [], []
        for z, s in zip(column(batch, "z"), column(batch, "spans"), strict=True):
            words = unpack(z).split()
            mark = np.zeros(len(words) + 1, dtype=np.int32)
            if s:
                np.add.at(mark, [r["first"] for r in s], 1)
                np.add.at(mark, [r["last"] + length for r in s], -1)
            keep = np.cumsum(mark[:-1]) == 0
            total.append(len(words))
            gone.append(len(words) - int(keep.sum()))
            left.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if s else words))
        return {"doc_id": batch.column(0), "n_words": total, "n_removed": gone, "kept_sha256": [hashlib.sha256(b).hexdigest() for b in left]} | ({"kept": left} if kept else {})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * kept
    return arrow(packed.join(spans, "uid", "left").select("doc_id", "z", "spans"), run, schema)
