"""Exact removal of repeated byte strings by a distributed, sparse suffix array.

Only suffixes at anchors (anchors.py) are sorted. That covers every ``length``-byte window: a window's anchor is a function
of its bytes alone, so equal windows have anchors at one offset, and the suffixes at these agree from the anchor to the
window's end while the bytes before them agree back to its start. A suffix is therefore written as a key: the bytes from
the anchor on (``length`` of them at most), then those before it backwards (``length - k`` at most), both cut to the run of
windows that have this anchor and filled up with a byte that UTF-8 never has.

1. Suffixes whose anchor string occurs once are left out (a filter by hash; it may keep too many, never too few). Equal
   keys of one batch collapse to one row marked ``multi``, so that periodic texts stay small.
2. Sampled splitters range-partition the keys by their leading bytes, ties by row and position, so that a very common
   suffix is spread over buckets. Each bucket sorts its keys by multikey quicksort and compares neighbours byte by byte.
   Equal keys repeat with all their windows. Of different ones with one anchor, a pair with r bytes in common after the
   anchor and l before it shares the windows that start between l and length - r bytes before it; the pairs that matter
   are found by joining neighbours from the longest common r down, each time at the nearest l (``shared_windows``).
3. Windows that might also occur beyond a bucket's bounds (as far as the bytes in common with its first or last key allow)
   are suffixes of their own in a second sort over all buckets. Ends of buckets, two rows each, meet on the driver.

Rows are told apart by a written number. Positions never leave a document. Texts move zstd-packed. Long texts are read in
segments of ``SEGMENT`` windows, so that no step holds more than a few megabytes of a text beside the text itself.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.anchors import BYTES, anchored
from polyseek.llm.common import arrow, column, numbered, parts, saved, small_batches

LENGTH = 200
#: Bytes of the keys of a bucket, about: a task holds them.
BUCKET_BYTES = 256 << 20
#: Bytes of an anchor: with 50, about one position in 76 is one.
ANCHOR = 50
SEGMENT = 1 << 20
#: What fills keys up: no byte of UTF-8.
FILL = 255
ANCHORS = "kind int, h long, uid long, at int, first int, last int, multi int"
KEYS = "key binary, uid long, at int, first int, last int, multi int"
FOUND = "kind int, pid int, side int, uid long, at int, first int, last int, multi int, n int, apart int, key binary"


def keys_of(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, left: int) -> np.ndarray:
    """The keys of suffixes in data, a row of bytes each, whole words of 8 bytes."""
    out = np.zeros((len(at), -(-(length + left) // 8) * 8), dtype=np.uint8)
    top = max(len(data) - 1, 0)
    after = at[:, None] + np.arange(length)
    out[:, :length] = np.where(after < (last + length)[:, None], data[np.minimum(after, top)], FILL)
    if left:
        before = at[:, None] - 1 - np.arange(left)
        out[:, length : length + left] = np.where(before >= first[:, None], data[np.maximum(before, 0)], FILL)
    return out


def merged(uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of window starts by uid, with those that touch or overlap made one."""
    if not len(uid):
        return uid, first, last
    order = np.lexsort((first, uid))
    uid, first, last = uid[order], first[order].astype(np.int64), last[order].astype(np.int64)
    group = np.cumsum(np.concatenate([[0], uid[1:] != uid[:-1]]))
    reach = np.maximum.accumulate(last + (group << 32)) - (group << 32)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (first[1:] > reach[:-1] + 1)])
    start = np.flatnonzero(new)
    return uid[start], first[start], reach[np.append(start[1:], len(uid)) - 1]


def _sequences(rows: Iterator[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(uid, offset, bytes) of texts, long ones in overlapping segments, in lists of about a segment."""
    held, size = [], 0
    for uid, raw in rows:
        for at in range(0, max(len(raw) - length + 1, 0), SEGMENT):
            piece = raw[at : at + SEGMENT + length - 1]
            if held and size + len(piece) > SEGMENT:
                yield held
                held, size = [], 0
            held.append((uid, at, piece))
            size += len(piece)
    if held:
        yield held


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the stretches a and b (start, stop, anchor) have the same bytes and anchors at one place. A distance that
    very many pairs have, as in a periodic text, is compared once for all of them."""
    out = (stop[a] - start[a] == stop[b] - start[b]) & (at[a] - start[a] == at[b] - start[b])
    gap = start[b] - start[a]
    todo = np.flatnonzero(out)
    distance, counts = np.unique(gap[todo], return_counts=True)
    for d in distance[(counts * 200 > len(data)) & (distance > 0)].tolist():
        other = np.concatenate([[0], np.cumsum(data[:-d] != data[d:], dtype=np.int32)])
        i = todo[gap[todo] == d]
        out[i] = other[stop[a[i]]] == other[start[a[i]]]
        todo = todo[gap[todo] != d]
    for i in todo.tolist():
        out[i] = data[start[a[i]] : stop[a[i]]].tobytes() == data[start[b[i]] : stop[b[i]]].tobytes()
    return out


def _anchors(length: int, k: int):
    """Rows of a batch of texts: kind 0, spans of windows that repeat within it; 1, suffixes whose anchor string does; 2,
    the others; 3, one row for each anchor string of kind 1."""
    left = length - k

    def rows(sequences: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(b) for _, _, b in sequences], dtype=np.int64)])
        data = np.frombuffer(b"".join(b for _, _, b in sequences), dtype=np.uint8)
        x = anchored(BYTES[data], offsets, length, k)
        at, first, last, h, c = x["anchor"], x["first"], x["last"], x["h"], x["c"]
        shift = np.array([a for _, a, _ in sequences], dtype=np.int64)[x["seq"]] - offsets[x["seq"]]
        uid = np.array([u for u, _, _ in sequences], dtype=np.int64)[x["seq"]]
        # Runs of one content, by hash and then by their bytes: each is compared with the one before.
        order = np.lexsort((first, c))
        same = np.zeros(len(order), dtype=bool)
        again = np.flatnonzero(c[order][1:] == c[order][:-1])
        same[again + 1] = _equal(data, order[again], order[again + 1], at, first, last + length)
        head = np.flatnonzero(~same)
        multi = np.zeros(len(order), dtype=np.int32)
        multi[order[head[np.diff(np.append(head, len(order))) > 1]]] = 1
        same[order] = same.copy()
        gone = np.flatnonzero(same | (multi > 0))
        su, sf, sl = merged(uid[gone], first[gone] + shift[gone], last[gone] + shift[gone])
        keep = np.flatnonzero(~same)
        values, back, counts = np.unique(h[keep], return_inverse=True, return_counts=True)
        shared = counts[back] > 1
        probe = values[counts > 1]
        none, n = np.zeros(len(probe), dtype=np.int64), len(su)
        parts_ = {
            "kind": [np.zeros(n), np.where(shared, 1, 2), none + 3], "h": [su, h[keep].view(np.int64), probe.view(np.int64)], "uid": [su, uid[keep], none - 1],
            "at": [sf, at[keep] + shift[keep], none], "first": [sf, first[keep] + shift[keep], none], "last": [sl, last[keep] + shift[keep], none], "multi": [np.zeros(n), multi[keep], none],
        }
        return pa.RecordBatch.from_pydict({c_: np.concatenate(v).astype(np.int64 if c_ in ("h", "uid") else np.int32) for c_, v in parts_.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for sequences in _sequences(zip(column(batch, "uid"), map(unpack, column(batch, "z")), strict=True), length):
                yield rows(sequences)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h: spans and suffixes that are known, and the suffixes whose h another row has."""
    rest: pa.Table | None = None

    def done(t: pa.Table) -> pa.RecordBatch | None:
        kind, h = t.column("kind").to_numpy(), t.column("h").to_numpy()
        if not len(h):
            return None
        ask = kind >= 2
        hs = h[ask]  # sorted still
        twice = np.zeros(len(hs), dtype=bool)
        equal = hs[1:] == hs[:-1]
        twice[1:] |= equal
        twice[:-1] |= equal
        keep = kind < 2
        keep[np.flatnonzero(ask)[twice & (kind[ask] == 2)]] = True
        out = t.filter(pa.array(keep)).drop_columns(["h"])
        return pa.RecordBatch.from_pydict({"kind": np.minimum(out.column("kind").to_numpy(), 1).astype(np.int32)} | {c: out.column(c).combine_chunks() for c in out.column_names[1:]})

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        h = t.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if cut:
            yield done(t.slice(0, cut))
        rest = t.slice(cut)
        if rest.num_rows > 1 << 16:  # one value for long: two rows speak for it
            out = done(rest)
            yield out
            rest = pa.Table.from_pydict({c: np.array([3 if c == "kind" else h[-1] if c == "h" else 0] * 2, dtype=rest.column(c).type.to_pandas_dtype()) for c in rest.column_names})
    if rest is not None and rest.num_rows:
        yield done(rest)


def _with_keys(length: int, left: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            held: list = []
            for uid, z, runs in zip(column(batch, "uid"), column(batch, "z"), batch.column(2), strict=True):
                data = np.frombuffer(unpack(z), dtype=np.uint8)
                values = runs.values
                at, first, last, multi = (values.field(c).to_numpy().astype(np.int64) for c in ("at", "first", "last", "multi"))
                for s in range(0, len(at), 4096):
                    p = slice(s, s + 4096)
                    held.append((keys_of(data, at[p], first[p], last[p], length, left), np.full(len(at[p]), uid), at[p], first[p], last[p], multi[p]))
                    if sum(len(x[1]) for x in held) >= 4096:
                        yield _key_batch(held)
                        held = []
            if held:
                yield _key_batch(held)

    return run


def _key_batch(held: list) -> pa.RecordBatch:
    key = np.concatenate([x[0] for x in held])
    ends = np.arange(len(key) + 1, dtype=np.int32) * key.shape[1]
    binary = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(key))])
    uid, at, first, last, multi = (np.concatenate([x[i] for x in held]) for i in range(1, 6))
    return pa.RecordBatch.from_pydict({"key": binary, "uid": uid, "at": at.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32), "multi": multi.astype(np.int32)})


def with_keys(rows: DataFrame, packed: DataFrame, length: int, left: int) -> DataFrame:
    """(key, uid, at, first, last, multi) of suffixes (uid, at, first, last, multi), from the packed texts."""
    runs = rows.groupBy("uid").agg(F.collect_list(F.struct("at", "first", "last", "multi")).alias("runs"))
    return saved(packed.select("uid", "z").join(runs, "uid").select("uid", "z", "runs").mapInArrow(_with_keys(length, left), KEYS))


def multikey_sort(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the key columns: a quicksort by the first, then within runs of equal keys by the next, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.zeros(len(order), dtype=np.int64)
    for i, key in enumerate(keys[1:]):
        before = keys[i][order]
        run = np.cumsum(np.concatenate([[0], (before[1:] != before[:-1]) | (run[1:] != run[:-1])])[: len(order)])
        open_ = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(open_):
            break
        part = order[open_]
        by = np.argsort(key[part], kind="quicksort")
        by = by[np.argsort(run[open_][by], kind="stable")]
        order[open_] = part[by]
    return order


def sorted_keys(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, by multikey quicksort over words of 8 bytes."""
    words = keys.view(">u8")
    return multikey_sort([words[:, i].astype(np.uint64) for i in range(words.shape[1])])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b have in common from the start."""
    out = np.empty(len(a), dtype=np.int64)
    for s in range(0, len(a), 1 << 15):
        other = a[s : s + (1 << 15)] != b[s : s + (1 << 15)]
        out[s : s + (1 << 15)] = np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])
    return out


def shared_windows(before: list[bytes], after: list[int], length: int) -> list[tuple[int, int, int]]:
    """(i, r, l): bytes that suffix i has in common with another after and before its anchor, together ``length`` or more,
    with all pairs (r, l) that no other exceeds in both.

    before: what precedes each suffix, backwards; after: common bytes of each and the next in sorted order. Neighbours
    join from the greatest ``after`` down; of two groups that join, each member of the smaller meets those that are
    next to it, by ``before``, in the larger, which every best pair across the groups is among.
    """
    width = len(before[0])
    owner = list(range(len(before)))
    groups = [[(int.from_bytes(b, "big"), i)] for i, b in enumerate(before)]

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    out = []
    for e in sorted(range(len(after)), key=lambda i: -after[i]):
        r, a, b = after[e], find(e), find(e + 1)
        if len(groups[a]) > len(groups[b]):
            a, b = b, a
        small, big = groups[a], groups[b]
        for v in small:
            at = bisect_left(big, v)
            for q in (at - 1, at):
                if 0 <= q < len(big):
                    same = width - ((v[0] ^ big[q][0]).bit_length() + 7) // 8
                    if r + same >= length:
                        out += [(v[1], r, same), (big[q][1], r, same)]
        if len(small) < 8:
            for v in small:
                insort(big, v)
        else:
            big += small
            big.sort()
        groups[a], owner[a] = [], b
    return out


def _settle(length: int, left: int, k: int):
    """A bucket's keys sorted and compared. kind 0: spans of windows that repeat; 1: windows to be compared with other
    buckets; 2: its first and last key; 3: windows to be compared with other buckets if these have an anchor like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {"key": [], "uid": [], "at": [], "first": [], "last": [], "multi": []}
        width = -(-(length + left) // 8) * 8
        for batch in batches:
            if batch.num_rows:
                col = batch.column(0)
                ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
                got["key"].append(np.frombuffer(col.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, width))
                for i, c in enumerate(list(got)[1:]):
                    got[c].append(batch.column(i + 1).to_numpy().astype(np.int64))
        if not got["key"]:
            return
        key = np.concatenate(got.pop("key"))
        order = sorted_keys(key)
        key = key[order]
        uid, at, first, last, multi = (np.concatenate(v)[order] for v in got.values())
        lcp = common(key[:-1], key[1:])
        rep = np.flatnonzero(np.concatenate([[True], lcp < width]))  # the first row of each key
        n = np.add.reduceat(1 + multi, rep)
        rows_ = np.flatnonzero(np.repeat(n > 1, np.diff(np.append(rep, len(key)))) & (multi == 0))
        spans = [(uid[rows_], first[rows_], last[rows_])]
        apart = lcp[rep[1:] - 1]  # common bytes of each key and the next
        after_len, before_len = last[rep] + length - at[rep], at[rep] - first[rep]
        bound = np.flatnonzero(np.concatenate([[True], apart < k, [True]]))
        sizes = np.diff(bound)
        who, r, same = [], [], []
        two = bound[:-1][sizes == 2]
        if left and len(two):
            a, b = key[rep[two], length : length + left], key[rep[two + 1], length : length + left]
            both = common(a, b)
            who, r, same = [two, two + 1], [apart[two]] * 2, [both] * 2
        for g in np.flatnonzero(sizes > 2) if left else ():
            s, e = int(bound[g]), int(bound[g + 1])
            found = shared_windows([key[i, length : length + left].tobytes() for i in rep[s:e]], np.minimum(apart[s : e - 1], length).tolist(), length)
            if found:
                i, x, y = np.array(found, dtype=np.int64).T
                who.append(s + i), r.append(x), same.append(y)
        if who:
            i, x, y = (np.concatenate(v) for v in (who, r, same))
            lo, hi = length - np.minimum(x, after_len[i]), np.minimum(y, before_len[i])
            ok = np.flatnonzero((lo <= hi) & (n[i] == 1))
            j = rep[i[ok]]
            spans.append((uid[j], at[j] - hi[ok], at[j] - lo[ok]))
        su, sf, sl = merged(*(np.concatenate(v) for v in zip(*spans, strict=True)))
        pid = TaskContext.get().partitionId()
        for s in range(0, len(su), 1 << 16):
            p = slice(s, s + (1 << 16))
            yield _found(0, pid, uid=su[p], first=sf[p], last=sl[p])
        # The ends: how far the first and the last key reach into the bucket, and where their run of equal suffixes ends.
        right = np.minimum(apart, length)
        turn = np.flatnonzero(right < length)
        for side, i, edge in ((0, 0, turn[:1]), (1, len(rep) - 1, turn[-1:])):
            j = rep[i]
            yield _found(2, pid, side=np.array([side]), uid=uid[[j]], at=at[[j]], first=first[[j]], last=last[[j]], n=n[[i]], multi=np.array([int(len(rep) == 1)]), apart=right[edge] if len(edge) else np.array([-1]), key=pa.array([key[j].tobytes()], pa.binary()))
        if left:
            yield from _beyond(length, left, k, pid, key[rep], uid[rep], at[rep], first[rep], last[rep], n > 1, apart)

    return run


def _beyond(length: int, left: int, k: int, pid: int, key: np.ndarray, uid: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, many: np.ndarray, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows of a bucket's different keys that might occur in other buckets too, equal ones once (nearly).

    What is common to a key and any key beyond the bucket's first or last is common to it and that one. If less than
    ``length`` bytes after the anchor are, these bound a shared window's end. Otherwise a key beyond either agrees in all
    of them, and then the bytes before the anchor are bounded so (kind 1); or it differs after the anchor: how early is
    known only from the other buckets (kind 3).
    """
    width = key.shape[1]
    down = np.minimum.accumulate(np.concatenate([[width], apart]))
    up = np.minimum.accumulate(np.concatenate([apart, [width]])[::-1])[::-1]
    j = np.arange(left + 1)
    for s in range(0, len(key), 1 << 12):
        near = s + np.flatnonzero((down[s : s + (1 << 12)] >= k) | (up[s : s + (1 << 12)] >= k))
        if not len(near):
            continue
        most, least = at[near] - first[near], at[near] - last[near]
        ask = np.zeros((len(near), left + 1), dtype=bool)
        for side, reach in enumerate((down[near], up[near])):
            full = reach >= length
            ask |= np.where(full[:, None], j <= np.minimum(reach - length, left)[:, None], (reach >= k)[:, None] & (j >= (length - reach)[:, None]))
            later = np.flatnonzero(full & (reach - length < most))
            if len(later):
                i = near[later]
                yield _found(3, pid, side=np.full(len(i), side), uid=uid[i], at=at[i], first=first[i], last=at[i] - (reach[later] - length) - 1, multi=many[i])
        row, back = np.nonzero(ask & (j <= most[:, None]) & (j >= least[:, None]))
        text = np.concatenate([key[near, length : length + left][:, ::-1], key[near, :length]], axis=1)
        for t in range(0, len(row), 1 << 14):
            i, b = row[t : t + (1 << 14)], back[t : t + (1 << 14)]
            window = np.ascontiguousarray(text[i[:, None], (left - b)[:, None] + np.arange(length)])
            _, one, count = np.unique(window.view(f"V{length}").ravel(), return_index=True, return_counts=True)
            o = near[i[one]]
            p = at[o] - b[one]
            yield _found(1, pid, uid=uid[o], at=p, first=p, last=p, multi=many[o] | (count > 1))


def _found(kind: int, pid: int, **got: object) -> pa.RecordBatch:
    n = len(next(iter(got.values())))
    names = [f.split() for f in FOUND.split(", ")]
    base = {"kind": kind, "pid": pid}
    out = {}
    for name, kind_ in names:
        if name == "key":
            out[name] = got.get(name, pa.nulls(n, pa.binary()))
        else:
            out[name] = np.asarray(got[name] if name in got else np.full(n, base.get(name, 0))).astype(np.int64 if kind_ == "long" else np.int32)
    return pa.RecordBatch.from_pydict(out)


def across(ends: list, length: int) -> tuple[list[tuple], list[tuple]]:
    """What the ends of the buckets say once they are compared: (uid, first, last) of keys that the next bucket has too, and
    (pid, side, r): the most bytes after the anchor that a key beyond that side can share with the bucket's first or last
    key without sharing all.

    ends: kind 2 rows, two for each bucket with rows.
    """
    ends = sorted(ends, key=lambda r: (r.pid, r.side))
    buckets = [ends[i : i + 2] for i in range(0, len(ends), 2)]
    right = lambda r: bytes(r.key)[:length]
    same = lambda a, b: next((i for i in range(length) if a[i] != b[i]), length)
    spans, reach = set(), []
    for i, pair in enumerate(buckets):
        for side, step in ((0, -1), (1, 1)):
            here, o = pair[side], i + step
            if 0 <= o < len(buckets) and bytes(buckets[o][1 - side].key) == bytes(here.key):
                for r in (here, buckets[o][1 - side]):
                    if r.n == 1:
                        spans.add((r.uid, r.first, r.last))
            r = 0
            while 0 <= o < len(buckets):
                r = same(right(here), right(buckets[o][1 - side]))
                if r < length:
                    break
                r = buckets[o][1 - side].apart  # where that bucket's run of equal suffixes ends
                if r >= 0:
                    break
                r, o = 0, o + step
            reach.append((here.pid, side, r))
    return sorted(spans), reach


def settled(rows: DataFrame, length: int, left: int, k: int, n: int) -> tuple[DataFrame, DataFrame, int]:
    """(uid, first, last), spans of windows that repeat among ``n`` suffixes with keys; suffixes of one window each, still to
    be compared over all buckets, and how many these are at most. There are as many buckets as the keys' bytes ask for."""
    spark = rows.sparkSession
    small_batches(spark)
    dealt = rows.repartitionByRange(max(parts(spark), -(-n * (length + left) // BUCKET_BYTES)), "key", "uid", "at")
    found = saved(dealt.mapInArrow(_settle(length, left, k), FOUND))
    equal, reach = across(found.where("kind = 2").collect(), length)  # two rows a bucket
    spans = found.where("kind = 0").select("uid", "first", "last").union(spark.createDataFrame(equal, "uid long, first int, last int"))
    sides = spark.createDataFrame([r for r in reach if length - r[2] <= left], "pid int, side int, r int")  # at most two a bucket
    late = found.where("kind = 3").join(F.broadcast(sides), ["pid", "side"])
    late = late.select("uid", "first", F.least("last", F.col("at") - length + F.col("r")).alias("last"), "multi").where("first <= last")
    late = late.select("uid", F.explode(F.sequence("first", "last")).alias("at"), "multi")
    far = found.where("kind = 1").select("uid", "at", "multi").union(late).groupBy("uid", "at").agg(F.max("multi").alias("multi"))
    most = found.where("kind in (1, 3)").agg(F.sum(F.when(F.col("kind") == 1, 1).otherwise(F.col("last") - F.col("first") + 1))).first()[0] or 0
    return spans, far.select("uid", "at", F.col("at").alias("first"), F.col("at").alias("last"), "multi"), int(most)


def repeats(packed: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(uid, spans): first and last starts of repeated ``length``-byte strings, for packed texts (uid, z) with any."""
    spark = packed.sparkSession
    small_batches(spark)
    left = length - k
    rows = packed.select("uid", "z").mapInArrow(_anchors(length, k), ANCHORS)
    deal = F.when(F.col("kind") >= 2, F.col("h")).otherwise(F.xxhash64("uid", "at"))
    met = rows.repartition(parts(spark), deal).sortWithinPartitions("h").mapInArrow(_met, ANCHORS.replace("h long, ", ""))
    met = saved(met)
    runs = met.where("kind = 1").select("uid", "at", "first", "last", "multi")
    near, far, most = settled(with_keys(runs, packed, length, left), length, left, k, runs.count())
    single, _, _ = settled(with_keys(far, packed, length, 0), length, 0, k, most)
    spans = met.where("kind = 0").select("uid", "first", "last").union(near).union(single)
    return spans.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def cut(data: bytes, spans: list, length: int) -> tuple[bytes, int, int]:
    """What is left of data, bytes removed, and maximal removed runs."""
    if not spans:
        return data, 0, 0
    first = np.array([s["first"] for s in spans], dtype=np.int64)
    _, start, end = merged(np.zeros(len(first), dtype=np.int64), first, np.array([s["last"] for s in spans], dtype=np.int64) + length - 1)
    end = end + 1
    left = b"".join([data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)])
    return left, len(data) - len(left), len(start)


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, kept: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in this document or another;
    strings are judged on the input. Null texts count as empty; documents shorter than ``length`` stay whole. A null
    doc_id is no special case; repeated rows are copies, so all their strings of ``length`` bytes go. Columns other than
    doc_id and text are not read. An empty table gives an empty one.
    """
    packed = numbered(docs)
    spans = repeats(packed, length, k)

    def run(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        out = [(len(data := unpack(z)), *cut(data, s, length)) for z, s in zip(column(batch, "z"), column(batch, "spans"), strict=True)]
        return {
            "doc_id": batch.column(0), "n_bytes": [o[0] for o in out], "n_removed": [o[2] for o in out], "n_spans": [o[3] for o in out],
            "kept_sha256": [hashlib.sha256(o[1]).hexdigest() for o in out],
        } | ({"kept": [o[1] for o in out]} if kept else {})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return arrow(packed.join(spans, "uid", "left").select("doc_id", "z", "spans"), run, schema, most=1 << 19)


def cut_documents(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """docs with all their columns, text being what without_repeats() leaves of it: cut characters go whole, n_chars
    follows; a null text stays null, and a text that is all repeats becomes empty."""
    names = docs.columns
    rest = [c for c in names if c not in ("text", "n_chars")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    packed = numbered(docs, rest)
    spans = repeats(packed, length, k)

    def run(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        left = [None if n else cut(unpack(z), s, length)[0].decode("utf-8", "ignore") for n, z, s in zip(column(batch, "none"), column(batch, "z"), column(batch, "spans"), strict=True)]
        made = {"text": pa.array(left, pa.string()), "n_chars": pa.array([t if t is None else len(t) for t in left], pa.int64())}
        return {c: made[c] if c in made else batch.column(batch.schema.get_field_index(f"_{rest.index(c)}")) for c in names}

    schema = ", ".join(f"`{c}` {'string' if c == 'text' else 'long' if c == 'n_chars' else fields[c]}" for c in names)
    return arrow(packed.join(spans, "uid", "left").select(*[f"_{i}" for i in range(len(rest))], "none", "z", "spans"), run, schema, most=1 << 19)
