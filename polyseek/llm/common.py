"""What the operators of this package share: scratch tables, batch sizes, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.sources.scratch import folder as scratch

#: A word, as Java and Python patterns write it: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a partition, about, where their number follows from the data.
RANGE_BYTES = 128 << 20


def saved(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared scratch folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranges(spark: SparkSession, size: int) -> int:
    """Partitions for a table of ``size`` bytes: one for each ``RANGE_BYTES``, and no fewer than the session asks for."""
    return max(parts(spark), -(-size // RANGE_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, whatever others the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, most: int = 4 << 20) -> DataFrame:
    """Rows that f makes of each Arrow batch of df (of ``most`` bytes, about), f returning columns by name."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most):
                out = f(piece)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes each, so that long texts do not add up."""
    rows = max(1, batch.num_rows)
    step = max(1, int(rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def numbered(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """uid, doc_id, z (the text's UTF-8 bytes, zstd-packed; null as empty), none (whether the text is null) and the columns
    of ``keep`` as _0, _1 and so on, of each row of docs, written to the scratch folder: uid is a number of the row's own."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batch: pa.RecordBatch) -> dict:
        pack, text = zstandard.ZstdCompressor(level=3).compress, column(batch, "text_")
        out = {"uid": batch.column(0), "doc_id": batch.column(1), "z": [pack((t or "").encode()) for t in text], "none": [t is None for t in text]}
        return out | {f"_{i}": batch.column(3 + i) for i in range(len(keep))}

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id_"), F.col("text").cast("string").alias("text_"),
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)],
    )
    return saved(arrow(rows, run, ", ".join(["uid long, doc_id long, z binary, none boolean", *(f"_{i} {fields[c]}" for i, c in enumerate(keep))])))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in b" ".join(words)."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    return ends - sizes, ends


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
