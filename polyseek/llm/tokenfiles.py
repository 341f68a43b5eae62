"""Token ids in binary files: each document compressed for itself, with one zstandard dictionary shared by all.

A file holds, in this order: magic, number width (1 byte), SHA-256 of the dictionary (32 bytes); the documents' frames;
the index (for each document its doc_id, whether that is null, the frame's end and the number of ids); the number of
documents and the index's length (8 bytes each). A reader finds any document from the index and decompresses it alone.
The dictionary, trained on at most ``SAMPLE`` documents' id arrays, stands beside the files under its hash.
Files are numbered in ascending order of doc_id (nulls first, equal ones by a hash of the text). A task writes its file
whole under a name of its own and moves it into place, so a lost or repeated task leaves the same file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseek.llm.common import column, parts, pieces, ranges, saved, scratch, small_batches, texts
from polyseek.llm.tokens import encoder

END = 2
#: Documents that the dictionary is trained on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 1000, 16 << 20
DICTIONARY = 1 << 16
MAGIC = b"PSTOK001"
_HEAD = "<8sB32s"
_TAIL = "<QQ"
LEVEL = 3
#: Bytes that are read of a file at once, about, where all its documents are wanted.
READ = 8 << 20


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, name: str, chunks: Iterator[bytes]) -> None:
    fs, at = folder(uri)
    own = f"{at}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    fs.move(own, f"{at}/{name}")


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary for the sampled documents' id bytes; empty if there is too little to learn from."""
    samples = [s for s in samples if s]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def sample(docs: DataFrame, most: int = SAMPLE, size: int = SAMPLE_BYTES) -> list[str]:
    """Texts of at most ``most`` rows, those with the least hash of doc_id and text, and of ``size`` bytes in all."""
    rows = texts(docs).where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("_o"), F.octet_length("text").alias("_n"))
    rows = rows.where(F.col("_n") <= size).orderBy("_o", "doc_id").limit(most)  # three numbers a row
    upto = F.sum("_n").over(Window.orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ids = rows.withColumn("_upto", upto).where(F.col("_upto") <= size).select("doc_id", "_o").distinct()
    picked = texts(docs).where("text is not null").withColumn("_o", F.xxhash64("doc_id", "text")).join(F.broadcast(ids), ["doc_id", "_o"])
    return [r.text for r in picked.dropDuplicates(["doc_id", "_o"]).select("text").collect()]


def _frames(ids: list[bytes], dictionary: bytes) -> list[bytes]:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_dict_id=False).compress
    return [pack(b) for b in ids]


class TokenFile:
    """Reads one file: its index at once, documents one by one."""

    def __init__(self, uri: str, name: str, dictionary: bytes):
        fs, at = folder(uri)
        self.file = fs.open_input_file(f"{at}/{name}")
        size = self.file.size()
        self.file.seek(size - struct.calcsize(_TAIL))
        n, length = struct.unpack(_TAIL, self.file.read(struct.calcsize(_TAIL)))
        self.file.seek(0)
        magic, self.width, held = struct.unpack(_HEAD, self.file.read(struct.calcsize(_HEAD)))
        if magic != MAGIC or held != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: not a token file, or of another dictionary")
        self.file.seek(size - struct.calcsize(_TAIL) - length)
        index = zstandard.ZstdDecompressor().decompress(self.file.read(length), max_output_size=25 * n + 64)
        self.doc_id, self.ends, self.counts = (np.frombuffer(index, dtype="<i8", count=n, offset=8 * n * i) for i in range(3))
        self.null = np.frombuffer(index, dtype="u1", count=n, offset=24 * n).astype(bool)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def all_ids(self, block: int = READ) -> Iterator[np.ndarray]:
        """The ids of every document in order, read in stretches of about ``block`` bytes."""
        i, start = 0, struct.calcsize(_HEAD)
        while i < len(self.ends):
            j = max(i + 1, int(np.searchsorted(self.ends, start + block, side="right")))
            self.file.seek(start)
            held = self.file.read(int(self.ends[j - 1]) - start)
            low = 0
            for end, n in zip((self.ends[i:j] - start).tolist(), self.counts[i:j].tolist(), strict=True):
                yield np.frombuffer(self.unpack.decompress(held[low:end], max_output_size=max(1, n * self.width)), dtype=f"<u{self.width}")
                low = end
            i, start = j, int(self.ends[j - 1])

    def ids(self, i: int) -> np.ndarray:
        start = struct.calcsize(_HEAD) if i == 0 else int(self.ends[i - 1])
        self.file.seek(start)
        raw = self.unpack.decompress(self.file.read(int(self.ends[i]) - start), max_output_size=max(1, int(self.counts[i]) * self.width))
        return np.frombuffer(raw, dtype=f"<u{self.width}")


def write(docs: DataFrame, tokenizer: str, end: int = END) -> tuple[DataFrame, str, bytes]:
    """Encode docs (doc_id, text; null as empty), each followed by id ``end``. Gives (pid, name, n_docs, n_ids) of the
    files, their folder and the dictionary. An empty table makes no files. Repeated rows and null doc_ids (first of all) are
    documents of their own; columns other than doc_id and text are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    out = scratch(spark)
    fs, at = folder(out)
    fs.create_dir(at, recursive=True)
    dictionary = train(encoder(tokenizer).encode(sample(docs)))
    put(out, f"dictionary-{hashlib.sha256(dictionary).hexdigest()}", iter([dictionary]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        last = np.array([end], dtype=enc.dtype).tobytes()
        ids, ends, counts, null = array("q"), array("q"), array("q"), bytearray()  # 25 bytes a document

        def body() -> Iterator[bytes]:
            yield struct.pack(_HEAD, MAGIC, enc.dtype.itemsize, hashlib.sha256(dictionary).digest())
            at = struct.calcsize(_HEAD)
            for batch in batches:
                for piece in pieces(batch, 4 << 20):
                    got = [b + last for b in enc.encode([t or "" for t in column(piece, "text")])]
                    frames = _frames(got, dictionary)
                    for d, b, f in zip(column(piece, "doc_id"), got, frames, strict=True):
                        at += len(f)
                        ids.append(d or 0), null.append(d is None), ends.append(at), counts.append(len(b) // enc.dtype.itemsize)
                    yield b"".join(frames)
            index = b"".join(np.array(x, dtype="<i8").tobytes() for x in (ids, ends, counts)) + bytes(null)
            index = zstandard.ZstdCompressor(level=LEVEL).compress(index)
            yield index + struct.pack(_TAIL, len(ids), len(index))

        name = f"part-{pid:06d}.tok"
        put(out, name, body())
        if ids:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "name": [name], "n_docs": [len(ids)], "n_ids": [sum(counts)]})

    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    dealt = texts(docs).repartitionByRange(ranges(spark, size), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return saved(dealt.select("doc_id", "text").mapInArrow(run, "pid int, name string, n_docs long, n_ids long")), out, dictionary


def read(files: DataFrame, uri: str, dictionary: bytes) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    spark = files.sparkSession
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    todo = files.select("pid", "name", before.alias("base")).repartition(parts(spark), "pid")  # one row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(column(batch, "name"), column(batch, "base"), strict=True):
                f = TokenFile(uri, name, dictionary)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in f.all_ids()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(f.doc_id, pa.int64(), mask=f.null), "start": base + np.cumsum(f.counts) - f.counts, "n_tokens": np.asarray(f.counts), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
