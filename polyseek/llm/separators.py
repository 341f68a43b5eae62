"""Token counts of flat, unindexed token files by a scan for end-of-document ids.

A flat file is nothing but ids of fixed width, each document followed by the separator. Tasks read blocks of files by
byte range and find separators with one vectorised comparison; a block reports its separators' distances and where its
last one is. A prefix scan over the blocks of each file (sums of separator counts, greatest separator position) then
numbers the documents and completes those that cross block bounds. No block is read twice and none needs another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyseek.llm.common import column, parts, pieces, saved, scratch, small_batches, texts
from polyseek.llm.tokenfiles import folder
from polyseek.llm.tokens import encoder

BLOCK = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, end: int) -> tuple[DataFrame, str]:
    """Encode docs (null as empty) into one flat file a task. Gives (file, ordinal, doc_id), the order in which they were
    written, for callers that want to name the documents that a scan finds; and the files' folder. Repeated rows and null
    doc_ids are documents of their own; columns other than doc_id and text are not read; an empty table makes empty files."""
    spark = docs.sparkSession
    small_batches(spark)
    out = scratch(spark)
    fs, at = folder(out)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, literal=True)  # the separator must not come from a text
        last = np.array([end], dtype=enc.dtype).tobytes()
        fs, at = folder(out)
        name = f"flat-{TaskContext.get().partitionId():06d}.bin"
        own = f"{at}/.{name}-{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(own) as f:
            for batch in batches:
                for piece in pieces(batch, 4 << 20):
                    got = enc.encode([t or "" for t in column(piece, "text")])
                    f.write(last.join(got) + last if got else b"")
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(got), "ordinal": pa.array(range(n, n + len(got)), pa.int64()), "doc_id": piece.column(0)})
                    n += len(got)
        fs.move(own, f"{at}/{name}")

    return saved(texts(docs).mapInArrow(run, "file string, ordinal long, doc_id long")), out


def blocks(spark: SparkSession, uri: str, width: int, block: int = BLOCK) -> DataFrame:
    """(file, block, start, n): the blocks of all files in a folder, start and n counted in ids."""
    fs, at = folder(uri)
    files = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_"))]
    rows = spark.createDataFrame([(f.base_name, f.size // width) for f in files], "file string, size long")  # a row for each file
    step = max(1, block // width)
    rows = rows.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))).alias("block"))
    return rows.select("file", "size", "block", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("size") - F.col("block") * step).alias("n"))


def count(spark: SparkSession, uri: str, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the flat files of a folder; separators do not count, and ids
    after the last separator make one more document that has not ended. Empty files have no documents."""
    todo = blocks(spark, uri, width, block).repartition(parts(spark), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = folder(uri)
        for batch in batches:
            for name, size, no, start, n in zip(*(column(batch, c) for c in ("file", "size", "block", "start", "n")), strict=True):
                with fs.open_input_file(f"{at}/{name}") as f:
                    ids = np.frombuffer(f.read_at(n * width, start * width), dtype=f"<u{width}")
                where = np.flatnonzero(ids == end)
                lengths = (np.diff(where, prepend=-1) - 1).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "file": [name], "size": [size], "block": [no], "start": [start], "found": [len(where)], "last": pa.array([start + int(where[-1]) if len(where) else None], pa.int64()),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                })

    scanned = saved(todo.mapInArrow(run, "file string, size long, block long, start long, found long, last long, lengths array<long>"))
    # The prefix scan sees three numbers a block (40 bytes for each megabyte of a file); the lengths join it afterwards.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = scanned.select("file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("base"), (F.col("start") - F.coalesce(F.max("last").over(before), F.lit(-1)) - 1).alias("open"))
    done = scanned.select("file", "block", "lengths").join(scan.hint("merge"), ["file", "block"])
    done = done.select("file", "base", "open", F.posexplode("lengths").alias("i", "length"))
    done = done.select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("length") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = scanned.groupBy("file").agg(F.sum("found").alias("ordinal"), (F.max("size") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
    return done.union(rest.where("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False).alias("ended")))
