"""SimHash fingerprints and near-duplicate groups by anchor points of a covering code.

Each 64-bit fingerprint is seen as two halves. The perfect Hamming code of 31 bits covers the lower 31 bits of a half
with radius 1. Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one half, so with radius 1 plus
threshold 1 they share an anchor there: every fingerprint is replicated to the code words within distance 2 of each
half (1 or 16), and only fingerprints of one anchor are compared. An anchor of more than ``HOT`` different fingerprints is
cut finer by the other half, in which linked ones differ in at most 3 bits and so agree in one byte of four, and what is
still that large by its nibbles, of which they agree in five of eight. So no anchor's fingerprints add up in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.anchors import mixed
from polyseek.llm.common import arrow, column, parts, saved, small_batches, texts, word_bounds
from polyseek.llm.components import connected_components

#: Bits by which linked fingerprints may differ; the anchors above are made for at most this many.
THRESHOLD = 3
SEED = 42
#: Different fingerprints of one anchor that one task compares, at most, before the anchor is cut finer.
HOT = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's shingles of ``width`` words; 0 without a word, one shingle if there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    start, end = word_bounds(words)
    last = max(1, len(words) - width + 1)
    stop = end[width - 1 :] if len(words) >= width else end[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start[:last].tolist(), stop.tolist(), strict=True)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row, repeated ones too; fp holds the 64 bits as a signed long. Null and empty texts get 0;
    columns other than doc_id and text are not read."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, width) for t in column(batch, "text")], dtype=np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "fp": fp}

    return arrow(texts(docs), run, "doc_id long, fp long")


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each anchor within distance 2 of the lower 31 bits of a half of fps (uint64)."""
    rows, keys = [], []
    ones = np.arange(1, 32, dtype=np.uint64)
    for half in range(2):
        v = (fps >> np.uint64(32 * half)) & np.uint64((1 << 31) - 1)
        syndrome = np.zeros(len(v), dtype=np.uint64)
        for i in ones:
            syndrome ^= ((v >> (i - np.uint64(1))) & np.uint64(1)) * i
        tag = np.uint64(half << 31)
        exact = np.flatnonzero(syndrome == 0)
        rows.append(exact)
        keys.append(v[exact] | tag)
        off = np.flatnonzero(syndrome != 0)
        v, s = v[off], syndrome[off]
        rows.append(off)
        keys.append((v ^ (np.uint64(1) << (s - np.uint64(1)))) | tag)
        for i in ones:
            j = s ^ i
            pair = np.flatnonzero((j > i) & (j != 0))
            rows.append(off[pair])
            keys.append((v[pair] ^ (np.uint64(1) << (i - np.uint64(1))) ^ (np.uint64(1) << (j[pair] - np.uint64(1)))) | tag)
    return np.concatenate(rows), np.concatenate(keys)


#: Parts of the other half of which a linked fingerprint agrees in at least one: bytes, then five nibbles of eight.
FINER = (
    np.array([0xFF << 8 * i for i in range(4)], dtype=np.uint64),
    np.array([sum(0xF << 4 * i for i in some) for some in combinations(range(8), 5)], dtype=np.uint64),
)


def finer(anchors: np.ndarray, fps: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint with each part of the half that its anchor does not cover."""
    half = (anchors >> np.uint64(31)) & np.uint64(1)
    other = np.where(half == 0, fps >> np.uint64(32), fps & np.uint64((1 << 32) - 1))
    part = (other[:, None] & masks) | (np.arange(len(masks), dtype=np.uint64) << np.uint64(32))
    key = mixed(mixed(anchors)[:, None] + mixed(part + np.uint64(1)))
    # The half stays in its bit, so that a key can be cut again.
    key = (key & ~np.uint64(1 << 31)) | (half << np.uint64(31))[:, None]
    return np.repeat(np.arange(len(fps)), len(masks)), key.ravel()


def _group_edges(fps: np.ndarray, ids: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning set of the links in one large group: rows already joined to a pivot are not compared with it again."""
    root = np.arange(len(fps))
    out = []
    for p in range(len(fps)):
        others = np.flatnonzero(root != root[p])
        if not len(others):
            break
        near = others[np.bitwise_count(fps[others] ^ fps[p]) <= threshold]
        for r in np.unique(root[near]):
            q = near[root[near] == r][0]
            out.append((ids[p], ids[q]))
            root[root == r] = root[p]
    return out


def links(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted). Short runs are compared at all distances at once, long ones by pivots."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    size = np.repeat(sizes, sizes)
    a, b = [], []
    short = np.flatnonzero((size > 1) & (size <= 32))
    for step in range(1, 32):
        i = short[: len(short) - step] if step < len(short) else short[:0]
        i = i[(i + step < len(keys))]
        i = i[keys[i] == keys[i + step]]
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= threshold]
        a.append(ids[i])
        b.append(ids[i + step])
    for g in np.flatnonzero(sizes > 32):
        s = slice(bounds[g], bounds[g + 1])
        if found := _group_edges(fps[s], ids[s], threshold):
            x, y = np.array(found, dtype=np.int64).T
            a.append(x)
            b.append(y)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that join the reps of distinct (fp, rep), each fp once, that differ in at most ``threshold`` bits: all of
    small anchors, and a spanning set of large ones."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"threshold must be 0 to {THRESHOLD}")
    spark = distinct.sparkSession

    def replicate(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy()
        rows, keys = anchors_of(fp.view(np.uint64))
        return {"anchor": keys.view(np.int64), "fp": fp[rows], "rep": batch.column(1).to_numpy()[rows]}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if cut:
                a, b = links(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut], threshold)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
        if rest is not None and len(rest[0]):
            a, b = links(rest[0], np.ascontiguousarray(rest[1]).view(np.uint64), rest[2], threshold)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    small_batches(spark)
    replicas = arrow(distinct, replicate, "anchor long, fp long, rep long")
    for masks in FINER:
        hot = saved(replicas.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"))
        if hot.isEmpty():
            break

        def cut(batch: pa.RecordBatch, masks: np.ndarray = masks) -> dict:
            anchor, fp, rep = (batch.column(i).to_numpy() for i in range(3))
            rows, keys = finer(anchor.view(np.uint64), fp.view(np.uint64), masks)
            return {"anchor": keys.view(np.int64), "fp": fp[rows], "rep": rep[rows]}

        fine = arrow(replicas.join(hot, "anchor", "left_semi"), cut, "anchor long, fp long, rep long")
        replicas = saved(replicas.join(hot, "anchor", "left_anti").unionByName(fine))
    dealt = replicas.repartition(parts(spark), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def near_groups(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp) with component_id, the least doc_id reachable over links of at most ``threshold`` differing bits.

    Equal fingerprints collapse to their least doc_id before anything is compared, so copies never meet as pairs. Rows with
    a null doc_id get the component of equal fingerprints that have one, else null. An empty table gives an empty one.
    """
    fps = saved(fps)
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    roots = connected_components(fingerprint_links(distinct, threshold))
    group = saved(distinct.join(roots, F.col("rep") == F.col("v"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    return fps.join(group, "fp", "left").select("doc_id", "fp", "component_id")
