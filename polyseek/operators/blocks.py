"""Packed postings: blocks of a cell's embeddings as bytes, clustered by cell on disk, and their scores by byte tables.

A block is up to ``BLOCK`` embeddings of one cell in the order of their positions: document ids and packed codes as
binaries. Blocks are written in folders of neighbouring cells, sorted by cell inside, so a search reads the folders of the
cells that it probes and of these the row groups whose range of cells fits. Scores come from one table for each query token:
for every byte position and every value of a byte the sum that its codes add; packed codes are never unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.functions.arrow import long_lists

#: Embeddings of a block, folders of cells, bytes of a row group (small ones, so that a few cells read little).
BLOCK, FOLDERS, ROW_GROUP = 2048, 256, 8 << 20
#: Query tokens that meet a block at once (about), so that no cell's tokens have to fit one row.
TOKENS = 64
#: Bytes of probes (with their query vectors) up to which they are broadcast to the blocks; beyond, both are shuffled by cell.
PROBE_BYTES = 64 << 20

BLOCKS = "centroid_id long, first long, docs binary, packed binary"
SCORED = "query_id long, q_token_id long, doc_id long, embedding_pos long, rank int, score double"


def pack_bytes(codes: np.ndarray, nbits: int) -> np.ndarray:
    """Rows of codes as rows of bytes, the first code in the highest bits; a last byte that is not full ends in zeros."""
    per = 8 // nbits
    fill = -codes.shape[1] % per
    if fill:
        codes = np.concatenate([codes, np.zeros((len(codes), fill), codes.dtype)], axis=1)
    parts = codes.astype(np.uint8).reshape(len(codes), -1, per)
    out = np.zeros(parts.shape[:2], np.uint8)
    for i in range(per):
        out = (out << nbits) | parts[:, :, i]
    return out


def unpack_bytes(data: np.ndarray, nbits: int, width: int) -> np.ndarray:
    per, mask = 8 // nbits, (1 << nbits) - 1
    return np.stack([(data >> (nbits * (per - 1 - i))) & mask for i in range(per)], axis=2).reshape(len(data), -1)[:, :width]


def byte_tables(q: np.ndarray, weights: np.ndarray, nbits: int) -> np.ndarray:
    """(tokens x byte positions x 256): what each value of each byte adds to a token's score."""
    per = 8 // nbits
    fill = -q.shape[1] % per
    if fill:
        q = np.concatenate([q, np.zeros((len(q), fill))], axis=1)
    values = weights[unpack_bytes(np.arange(256, dtype=np.uint8)[:, None], nbits, per)]  # 256 x codes of a byte
    return q.reshape(len(q), -1, per) @ values.T


def blocks(postings: DataFrame, nbits: int, ranges: int) -> DataFrame:
    """``BLOCKS`` of postings(embedding_pos, centroid_id, doc_id, codes): range-partitioned by position, so that a large cell lies
    in several tasks, and cut where the cell changes."""
    rows = postings.select("embedding_pos", "centroid_id", "doc_id", "codes").repartitionByRange(ranges, "embedding_pos").sortWithinPartitions("embedding_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, cell, doc = (batch.column(i).to_numpy() for i in range(3))
            codes = batch.column(3)
            width = len(codes[0])
            packed = pack_bytes(codes.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), nbits)
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            out: dict = {"centroid_id": [], "first": [], "docs": [], "packed": []}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for s in range(a, b, BLOCK):
                    e = min(b, s + BLOCK)
                    out["centroid_id"].append(int(cell[s])), out["first"].append(int(pos[s]))
                    out["docs"].append(doc[s:e].astype("<i8").tobytes()), out["packed"].append(packed[s:e].tobytes())
            yield pa.RecordBatch.from_pydict({**out, "docs": pa.array(out["docs"], pa.binary()), "packed": pa.array(out["packed"], pa.binary())})

    return rows.mapInArrow(run, BLOCKS)


def write_blocks(blocks_: DataFrame, path: str, cells: int) -> int:
    """Write blocks in folders of neighbouring cells and return the cells of a folder."""
    per = max(1, -(-cells // FOLDERS))
    out = blocks_.withColumn("cell_folder", F.expr(f"centroid_id div {per}"))
    out.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("cell_folder").parquet(path)
    return per


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS + ", cell_folder long").parquet(path)


def of_cells(blocks_: DataFrame, cells: list[int], per_folder: int) -> DataFrame:
    """The blocks of given cells: a filter on folders, which prunes them, and on the cells' range, which prunes row groups; the
    cells themselves are met by the join that follows."""
    if not cells:
        return blocks_.where(F.lit(False))
    folders = sorted({c // per_folder for c in cells})
    return blocks_.where(F.col("cell_folder").isin(folders) & F.col("centroid_id").between(min(cells), max(cells)))


def scored(probes: DataFrame, counts: list[tuple[int, int]], width: int, blocks_: DataFrame, per_folder: int, weights: list[float], residuals: bool = True) -> DataFrame:
    """``SCORED``: of each probed block the best embedding of every document for each probing token (equal scores to nine digits:
    the lower position). probes(centroid_id, query_id, q_token_id, rank, score, qv); counts: (cell, its probes)."""
    spark = probes.sparkSession
    nbits = max(len(weights), 1).bit_length() - 1
    salts = spark.createDataFrame([(c, max(1, -(-n // TOKENS))) for c, n in counts], "centroid_id long, salts long")  # a row for each probed cell
    size = sum(n for _, n in counts) * (8 * width + 40)
    # Tokens of a cell in groups of bounded size, with their vectors, before any posting is touched.
    rows = probes.join(F.broadcast(salts) if 16 * len(counts) <= PROBE_BYTES else salts, "centroid_id").withColumn("_g", F.pmod(F.xxhash64("query_id", "q_token_id"), F.col("salts")))
    groups = rows.groupBy("centroid_id", "_g").agg(F.collect_list(F.struct("query_id", "q_token_id", "rank", "score", "qv")).alias("t")).drop("_g")
    near = of_cells(blocks_, [c for c, _ in counts], per_folder)
    met = near.join(F.broadcast(groups) if size <= PROBE_BYTES else groups, "centroid_id").select("first", "docs", "packed", "t")
    table = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = np.frombuffer(batch.column(1)[i].as_buffer(), dtype="<i8")
                tokens = batch.column(3)[i].values
                query, token, rank, cs = (tokens.field(j).to_numpy() for j in range(4))
                score = np.repeat(cs[:, None], len(docs), axis=1)
                if residuals:
                    q = tokens.field(4).flatten().to_numpy().reshape(len(query), -1)
                    packed = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8).reshape(len(docs), -1)
                    sums = byte_tables(q, table, nbits)
                    for b in range(packed.shape[1]):
                        score += sums[:, b, :][:, packed[:, b]]
                yield _best(query, token, rank, score, docs, batch.column(0)[i].as_py())

    return met.mapInArrow(run, SCORED)


def _best(query: np.ndarray, token: np.ndarray, rank: np.ndarray, score: np.ndarray, docs: np.ndarray, first: int) -> pa.RecordBatch:
    """The maximum over each document's run of embeddings, for every token at once."""
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    shown = np.round(score, 9)
    top = np.maximum.reduceat(shown, starts, axis=1)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(docs))))
    at = np.where(shown == top[:, run], np.arange(len(docs)), len(docs))
    at = np.minimum.reduceat(at, starts, axis=1)
    who, n = np.arange(len(query)), len(starts)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(query, n)), pa.array(np.repeat(token, n)), pa.array(np.tile(docs[starts], len(query))), pa.array((first + at).ravel()), pa.array(np.repeat(rank, n)), pa.array(score[who[:, None], at].ravel())],
        names=["query_id", "q_token_id", "doc_id", "embedding_pos", "rank", "score"],
    )


def code_lists(rows: DataFrame, nbits: int, width: int) -> DataFrame:
    """rows with ``packed`` (binary) replaced by codes, an array of numbers."""
    at = rows.columns.index("packed")
    others = [f for f in rows.schema.fields if f.name != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(at).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            codes = long_lists(unpack_bytes(data, nbits, width).astype(np.int16))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), codes], names=[*(f.name for f in others), "codes"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "codes array<smallint>"]))


def block_rows(blocks_: DataFrame, nbits: int, width: int) -> DataFrame:
    """doc_id, embedding_pos, centroid_id, codes of blocks: a row for each embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = np.frombuffer(batch.column(2)[i].as_buffer(), dtype="<i8")
                data = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint8).reshape(len(docs), -1)
                pos = batch.column(1)[i].as_py() + np.arange(len(docs))
                cell = np.full(len(docs), batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(pos), pa.array(cell), long_lists(unpack_bytes(data, nbits, width).astype(np.int16))], names=["doc_id", "embedding_pos", "centroid_id", "codes"])

    return blocks_.select("centroid_id", "first", "docs", "packed").mapInArrow(run, "doc_id long, embedding_pos long, centroid_id long, codes array<smallint>")


def packed_rows(rows: DataFrame, nbits: int) -> DataFrame:
    """rows with codes (an array) replaced by ``packed``."""
    at = rows.columns.index("codes")
    others = [f for f in rows.schema.fields if f.name != "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(at)
            data = pack_bytes(codes.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), nbits) if batch.num_rows else np.zeros((0, 0), np.uint8)
            packed = pa.array([r.tobytes() for r in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), packed], names=[*(f.name for f in others), "packed"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "packed binary"]))
