"""Segments of unequal length - the token vectors of documents - in three forms, and gathers of them by id.

- lists: key, vectors (array of arrays).
- packed: blocks of up to ``ROWS`` segments, their numbers one after another: keys, offsets (in vectors, one more than keys)
  and flat, with nothing between them. Made from the offset buffers of Arrow columns, without a loop over vectors.
- padded: key, n, flat (vectors up to the longest of the block, the rest zeros) and mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024
PACKED = "keys binary, offsets binary, flat binary, width int"
PADDED = "key long, n int, width int, flat array<double>, mask array<boolean>"
LISTS = "key long, vectors array<array<double>>"


def lists(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """The vectors of each key in the order of another column: a segment must fit a row, as a document does."""
    own = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"))))
    return rows.groupBy(F.col(key).cast("long").alias("key")).agg(own.alias("t")).select("key", F.col("t.v").alias("vectors"))


def _packed(keys: np.ndarray, offsets: np.ndarray, flat: np.ndarray, width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"keys": [keys.astype("<i8").tobytes()], "offsets": [offsets.astype("<i8").tobytes()], "flat": [flat.astype("<f8").tobytes()], "width": pa.array([width], pa.int32())})


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    raw = lambda j, t: np.frombuffer(batch.column(j)[i].as_buffer(), dtype=t)
    width = batch.column(3)[i].as_py()
    return raw(0, "<i8"), raw(1, "<i8"), raw(2, "<f8").reshape(-1, max(width, 1)), width


def packed(segments: DataFrame, rows: int = ROWS) -> DataFrame:
    """Lists to ``PACKED``; keys without vectors have a segment of length 0. All vectors must be of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                outer = batch.column(1)
                inner = outer.flatten()
                flat = inner.flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(inner.offsets.to_numpy())
                if len(sizes) and (sizes != sizes[0]).any():
                    raise ValueError("vectors of one length are wanted")
                offsets = outer.offsets.to_numpy()
                yield _packed(batch.column(0).to_numpy(), offsets - offsets[0], flat, int(sizes[0]) if len(sizes) else 0)

    return segments.select("key", F.coalesce("vectors", F.array().cast("array<array<double>>")).alias("vectors")).mapInArrow(run, PACKED)


def unpacked(blocks: DataFrame) -> DataFrame:
    """``PACKED`` to lists, by the offsets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, offsets, flat, width = _read(batch, i)
                n = int(offsets[-1])
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(flat[:n].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner)], names=["key", "vectors"])

    return blocks.mapInArrow(run, LISTS)


def padded(blocks: DataFrame, longest: int | None = None) -> DataFrame:
    """``PACKED`` to ``PADDED``: every segment as long as the longest of its block, or ``longest`` (longer ones are cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, offsets, flat, width = _read(batch, i)
                sizes = np.diff(offsets)
                most = longest if longest is not None else int(sizes.max(initial=0))
                sizes = np.minimum(sizes, most)
                mask = np.arange(most) < sizes[:, None]
                view = np.zeros((len(keys), most, max(width, 1)))
                view[mask] = flat[(offsets[:-1, None] + np.arange(most))[mask]]
                view = view[:, :, :width]
                step = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * int(np.prod(x.shape[1:]))), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes.astype(np.int32)), pa.array(np.full(len(keys), width, np.int32)), step(view), step(mask)], names=["key", "n", "width", "flat", "mask"])

    return blocks.mapInArrow(run, PADDED)


def from_padded(rows: DataFrame) -> DataFrame:
    """``PADDED`` to lists: what the mask covers."""
    at = lambda i: F.slice("flat", (i * F.col("width") + 1).cast("int"), F.col("width"))
    return rows.select("key", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), at)).otherwise(F.array().cast("array<array<double>>")).alias("vectors"))


def gathered(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The segments of wanted(key) as lists, a row for each wanted row whose key is there (repeated ones too): the wanted keys of a
    block come to it as one list, and its offsets give the stretches, without looking at other segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, offsets, flat, width = _read(batch, i)
                want = batch.column(4)[i].values.to_numpy()
                order = np.argsort(keys, kind="stable")
                seg = order[np.searchsorted(keys[order], want)]
                sizes = offsets[seg + 1] - offsets[seg]
                ends = np.cumsum(sizes)
                rows = np.repeat(offsets[seg] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * width + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)), pa.array(flat[rows].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(want), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), inner)], names=["key", "vectors"])

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.frombuffer(batch.column(0)[i].as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([batch.column(1)[i].as_py()] * len(keys), pa.string())], names=["key", "block"])

    named = blocks.withColumn("block", F.sha1("keys"))  # keys of a segment stand in one block only
    where = named.select("keys", "block").mapInArrow(keys_of, "key long, block string")
    asked = wanted.select(F.col("key").cast("long").alias("key")).join(where, "key").groupBy("block").agg(F.collect_list("key").alias("want"))
    return named.join(asked, "block").select("keys", "offsets", "flat", "width", "want").mapInArrow(run, LISTS)
