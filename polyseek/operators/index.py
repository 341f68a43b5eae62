"""Building the index: centroids, assignment, residual codec, postings. All are tables; a build is one lazy plan but for
the codec's few numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyseek.functions.arrow import long_lists
from polyseek.functions.arrow import matrix as vector_matrix
from polyseek.functions.quantiles import exact_quantiles
from polyseek.functions.vectors import add, dot, normalise, pick, sub, tie
from polyseek.operators import blocks
from polyseek.plans import config
from polyseek.sources.scratch import stored

#: Bytes up to which the smaller side of an all-pairs product is broadcast; beyond it is met in blocks.
BROADCAST_BYTES = 64 << 20
#: Documents of a part of a cell in whose order positions are counted, by their id.
PART = 1 << 20
#: Centroids of one matrix product, postings of a range of a saved copy.
PRODUCT, RANGE_ROWS = 4096, 1 << 21
#: Documents whose ids become a filter of a scan, at most.
FEW = 10_000


@dataclass
class Index:
    """postings(embedding_pos, centroid_id, doc_id, pos, codes), centroids(centroid_id, cv, size, start), the codec.

    A saved index has its postings twice: ``blocks`` (blocks.BLOCKS in folders of ``per_folder`` neighbouring cells), which a
    search reads by cell, and rows in the order of documents with packed codes, for what starts from documents."""

    postings: DataFrame
    centroids: DataFrame
    cutoffs: list[float]
    weights: list[float]
    blocks: DataFrame | None = None
    per_folder: int = 1
    documents: DataFrame | None = None
    width: int = 0

    @property
    def nbits(self) -> int:
        return max(len(self.weights), 1).bit_length() - 1

    def of_documents(self, docs: DataFrame) -> DataFrame:
        """The postings, with codes, of documents(doc_id). A saved index is read in the order of documents: up to ``FEW`` ids become a filter
        on their range, which prunes row groups, and codes are unpacked of the rows found only."""
        docs = docs.select("doc_id").distinct()
        if self.documents is None:
            return self.postings.join(docs, "doc_id", "left_semi")
        rows = self.documents
        found = [r.doc_id for r in docs.limit(FEW + 1).collect()]  # at most FEW + 1 ids
        if len(found) <= FEW:
            found = sorted(d for d in found if d is not None)
            rows = rows.where(F.col("doc_id").between(found[0], found[-1])) if found else rows.where(F.lit(False))
        return blocks.code_lists(rows.join(docs, "doc_id", "left_semi"), self.nbits, self.width)

    def clustered(self, path: str) -> Index:
        """This index with its postings written to path in blocks by cell."""
        spark = self.postings.sparkSession
        cells = (self.centroids.agg(F.max("centroid_id")).first()[0] or 0) + 1
        per = blocks.write_blocks(blocks.blocks(self.postings, self.nbits, ranges_of(self.postings)), path, cells)
        return replace(self, blocks=blocks.read_blocks(spark, path), per_folder=per)

    def save(self, path: str) -> None:
        """Postings by cell and by document, centroids, codec, and what they are made of as one line of JSON."""
        spark = self.postings.sparkSession
        per = self.clustered(f"{path}/cells").per_folder
        rows = self.postings.repartitionByRange(ranges_of(self.postings), "doc_id").sortWithinPartitions("doc_id", "pos")
        blocks.packed_rows(rows, self.nbits).write.mode("overwrite").option("parquet.block.size", blocks.ROW_GROUP).parquet(f"{path}/documents")
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        width = self.centroids.agg(F.max(F.size("cv"))).first()[0]
        codec = [(self.cutoffs, self.weights, width, per)]
        spark.createDataFrame(codec, CODEC).write.mode("overwrite").json(f"{path}/codec")
        about = metadata(spark.read.parquet(f"{path}/documents"), len(self.weights)).first().asDict()
        spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str, check: bool = True) -> Index:
        """The saved index; with ``check`` its positions must be 0..n-1, each once, and its cells' sizes their number."""
        codec = spark.read.schema(CODEC).json(f"{path}/codec").first()
        rows = spark.read.parquet(f"{path}/documents")
        nbits = max(len(codec.weights), 1).bit_length() - 1
        out = cls(blocks.code_lists(rows, nbits, codec.width), spark.read.parquet(f"{path}/centroids"), codec.cutoffs, codec.weights, blocks.read_blocks(spark, f"{path}/cells"), codec.per_folder, rows, codec.width)
        if check:
            r = integrity(replace(out, postings=rows)).first()
            n = out.blocks.agg(F.sum(F.length("docs") / 8).cast("long")).first()[0] or 0
            if not (n == r.n_embeddings == r.n_positions == (r.sum_sizes or 0) and (r.last_pos is None or r.last_pos == r.n_embeddings - 1)):
                raise ValueError(f"{path}: not a whole index: {r.asDict()}, {n} in blocks")
        return out


CODEC = "cutoffs array<double>, weights array<double>, width int, per_folder int"


def ranges_of(postings: DataFrame) -> int:
    """Partitions of a range-partitioned copy of postings: one for each ``RANGE_ROWS`` of them, no fewer than the session asks for."""
    return max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-postings.count() // RANGE_ROWS))


def metadata(postings: DataFrame, levels: int, chunk: int = 25_000) -> DataFrame:
    """One row: passages, chunks of them, embeddings, cells with any, mean length and bits of a code."""
    return postings.agg(
        F.countDistinct("doc_id").alias("num_passages"), F.ceil(F.countDistinct("doc_id") / chunk).alias("num_chunks"), F.count("*").alias("num_embeddings"),
        F.countDistinct("centroid_id").alias("num_partitions"), (F.count("*") / F.countDistinct("doc_id")).alias("avg_doclen"), F.lit(max(levels, 1).bit_length() - 1).alias("nbits"),
    )


@dataclass(frozen=True)
class CentroidMatrix:
    """The centroids of an index as one matrix in the order of their ids, for a broadcast behind a check of its size."""

    ids: np.ndarray
    sizes: np.ndarray
    vectors: np.ndarray


def centroid_matrix(centroids: DataFrame) -> CentroidMatrix | None:
    """The matrix, or None where it is larger than ``BROADCAST_BYTES`` or rows differ in length."""
    n, low, high = centroids.agg(F.count("*"), F.min(F.size("cv")), F.max(F.size("cv"))).first()
    if not n or low != high or n * high * 8 > BROADCAST_BYTES:
        return None
    size = F.col("size") if "size" in centroids.columns else F.lit(0)
    rows = centroids.select("centroid_id", size.cast("long").alias("size"), F.col("cv").cast("array<double>").alias("cv")).toArrow().sort_by("centroid_id")
    flat = rows.column("cv").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return CentroidMatrix(rows.column("centroid_id").to_numpy(), rows.column("size").to_numpy(), flat.reshape(n, high))


def products(left: DataFrame, right: DataFrame, right_rows: int | None = None, width: int | None = None) -> DataFrame:
    """Every row of left with every row of right (the smaller side): a broadcast if that side's size allows it, else
    blocks of it that each left row visits. Rows and vector length are measured unless they are known."""
    if right_rows is None or width is None:
        vector = next((f.name for f in right.schema.fields if f.dataType.typeName() == "array"), None)
        n, w = right.agg(F.count("*"), F.max(F.size(vector)) if vector else F.lit(1)).first()
        right_rows, width = right_rows or n, width or max(w or 1, 1)
    if right_rows * width * 8 <= BROADCAST_BYTES:
        return left.crossJoin(F.broadcast(right))
    blocks = -(-right_rows * width * 8 // BROADCAST_BYTES)
    right = right.withColumn("_b", F.pmod(F.xxhash64(*right.columns[:1]), F.lit(blocks)))
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    return left.join(right, "_b").drop("_b")


def assign(tokens: DataFrame, centroids: DataFrame, key: str = "vec_id", rows: int | None = None) -> DataFrame:
    """tokens(key, v, ...) with the centroid_id of greatest dot product (ties: least id) and its cv.

    Centroids that fit a broadcast meet each Arrow batch in one matrix product: nothing is shuffled. Larger ones are met
    in blocks, and each row keeps its best."""
    near = centroids.select("centroid_id", "cv")
    held = centroid_matrix(near) if rows is None or rows > 0 else None
    if held is not None:
        # Only key and vector go through Python; other columns come back by the row they belong to.
        found = best_centroid(tokens, held)
        return found.join(F.broadcast(near), "centroid_id")
    best = products(tokens.select(key, "v"), near, rows)
    best = best.groupBy(key).agg(F.max(F.struct(tie(dot(F.col("v"), F.col("cv"))).alias("s"), (-F.col("centroid_id")).alias("c"))).alias("m"))
    return tokens.join(best.select(key, (-F.col("m.c")).alias("centroid_id")), key).join(near, "centroid_id")


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The row of centres with the greatest dot product (to nine digits; ties: the first) for each row of v."""
    top, who = np.full(len(v), -np.inf), np.zeros(len(v), dtype=np.int64)
    for b in range(0, len(centres), PRODUCT):
        score = np.round(v @ centres[b : b + PRODUCT].T, 9)
        i = score.argmax(axis=1)
        s = score[np.arange(len(v)), i]
        who, top = np.where(s > top, b + i, who), np.maximum(s, top)
    return who


def best_centroid(tokens: DataFrame, held: CentroidMatrix) -> DataFrame:
    """tokens(v, ...) with centroid_id, by one matrix product for each batch and block of centroids."""
    shared = tokens.sparkSession.sparkContext.broadcast(held)  # at most BROADCAST_BYTES
    at = tokens.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            who = nearest(vector_matrix(batch.column(at), m.vectors.shape[1]), m.vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.ids[who].astype(np.int64))], names=[*batch.schema.names, "centroid_id"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, centroid_id long")


def cell_sums(tokens: DataFrame, held: CentroidMatrix) -> DataFrame:
    """centroid_id, n, s: number and sum of the vectors of each cell. A task adds its own vectors up in one matrix, so that the
    shuffle carries cells x tasks rows, which the tasks behind it add up again as they come."""
    shared = tokens.sparkSession.sparkContext.broadcast(held)  # at most BROADCAST_BYTES
    rows = tokens.select(F.col("v").cast("array<double>").alias("v"))
    schema = "centroid_id long, n long, s array<double>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        count, total = np.zeros(len(m.ids), np.int64), np.zeros_like(m.vectors)
        for batch in batches:
            v = vector_matrix(batch.column(0), m.vectors.shape[1])
            if len(v):
                who = nearest(v, m.vectors)
                order = np.argsort(who, kind="stable")
                cell, first, n = np.unique(who[order], return_index=True, return_counts=True)
                total[cell] += np.add.reduceat(v[order], first, axis=0)
                count[cell] += n
        there = np.flatnonzero(count)
        for s in range(0, len(there), PRODUCT):
            c = there[s : s + PRODUCT]
            yield pa.RecordBatch.from_arrays([pa.array(m.ids[c]), pa.array(count[c]), long_lists(total[c])], names=["centroid_id", "n", "s"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                s = vector_matrix(batch.column(2), len(batch.column(2)[0]))
                for c, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), s, strict=True):
                    if c in sums:
                        sums[c][0] += n
                        sums[c][1] += x
                    else:
                        sums[c] = [n, x.copy()]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), long_lists(np.stack([x for _, x in sums.values()]))], names=["centroid_id", "n", "s"])

    return rows.mapInArrow(own, schema).repartition("centroid_id").mapInArrow(merged, schema)


def lloyd(tokens: DataFrame, centroids: DataFrame, rounds: int, rows: int | None = None) -> DataFrame:
    """Spherical k-means from given centroids; a cell without tokens keeps its centroid. Centroids that fit a broadcast are
    summed up inside the tasks; larger sets are met in blocks, a row for each component of a token. Rounds past the
    fourth should start from a written table: each one deepens the plan."""
    for _ in range(rounds):
        held = centroid_matrix(centroids.select("centroid_id", "cv")) if rows is None or rows > 0 else None
        if held is not None:
            means = cell_sums(tokens, held).select("centroid_id", normalise(F.transform("s", lambda x: x / F.col("n"))).alias("new"))
        else:
            at = assign(tokens.select("vec_id", "v"), centroids, rows=rows)
            sums = at.select("centroid_id", F.posexplode("v").alias("d", "x")).groupBy("centroid_id", "d").agg(F.avg("x").alias("x"))
            means = sums.groupBy("centroid_id").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("m")).select("centroid_id", normalise(F.col("m.x")).alias("new"))
        centroids = centroids.select("centroid_id", "cv").join(means, "centroid_id", "left").select("centroid_id", F.coalesce("new", "cv").alias("cv"))
    return centroids


def order_of(key: str, seed: int = 12345) -> Column:
    """A random order of rows that is the same in every run and engine."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string")))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 12345) -> DataFrame:
    """n rows of least hash: the same ones in every run."""
    return rows.orderBy(order_of(key, seed), key).limit(n)


#: Share and number of sampled embeddings that the codec is measured on, at most.
HELD_SHARE, HELD_MOST = 0.05, 50_000


def sample_split(tokens: DataFrame, seed: int = 12345) -> DataFrame:
    """The tokens of sampled passages (their number: config.sample_size) with ``heldout``: the first by hash, a twentieth
    or ``HELD_MOST`` of them at most, one at least."""
    passages = tokens.select("doc_id").distinct()
    picked = sampled(passages, "doc_id", config.sample_size(passages.count()), seed)
    rows = tokens.join(F.broadcast(picked) if picked.count() * 8 <= BROADCAST_BYTES else picked, "doc_id", "left_semi")
    n = rows.count()
    held = sampled(rows.select("vec_id"), "vec_id", max(1, min(int(HELD_SHARE * n), HELD_MOST)), seed + 1).withColumn("heldout", F.lit(True))
    return rows.join(F.broadcast(held), "vec_id", "left").withColumn("heldout", F.coalesce("heldout", F.lit(False)))  # at most HELD_MOST ids


def build_from_sample(tokens: DataFrame, nbits: int = 4, rounds: int = 4, seed: int = 12345, cells_: int | None = None) -> Index:
    """The whole build: sample of passages, number of cells from the number of embeddings, Lloyd's k-means on the sample
    without what is held out, the codec on that, then all tokens."""
    split = stored(sample_split(tokens, seed))
    train = split.where("not heldout")
    k = min(cells_ or config.partitions(tokens.count()), train.count())
    first = sampled(train.select("vec_id", "v"), "vec_id", k, seed + 2)
    ids = Window.orderBy("vec_id")  # one row for each cell
    centroids = first.select((F.row_number().over(ids) - 1).cast("long").alias("centroid_id"), F.col("v").alias("cv"))
    for _ in range(rounds):
        centroids = stored(lloyd(train, centroids, 1))
    res = residuals(assign(split.where("heldout").select("vec_id", "v"), centroids))
    return build(tokens, centroids, nbits, codec=codec_frame(res, nbits))


def residuals(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("r", sub(F.col("v"), F.col("cv")))


def codec_frame(res: DataFrame, nbits: int) -> DataFrame:
    """One row: cutoffs at i / 2**nbits, weights at (i + 1/2) / 2**nbits of all components, and the mean absolute one. Exact, by
    counting passes over the written residuals: no task sees all components."""
    spark, n = res.sparkSession, 1 << nbits
    x = stored(res.select("r"))
    mean = x.agg(F.sum(F.aggregate("r", F.lit(0.0), lambda s, v: s + F.abs(v))) / F.sum(F.size("r"))).first()[0]
    found = exact_quantiles(x, "r", [*(i / n for i in range(1, n)), *((i + 0.5) / n for i in range(n))])
    return spark.createDataFrame([(found and found[: n - 1], found and found[n - 1 :], mean)], "cutoffs array<double>, weights array<double>, avg_residual double")


def quantise(r: Column, cutoffs: list[float]) -> Column:
    """Per component the number of cutoffs strictly below it."""
    cuts = F.array(*[F.lit(float(c)) for c in cutoffs])
    return F.transform(r, lambda x: F.size(F.filter(cuts, lambda c: c < x)).cast("smallint"))


def packed(codes: Column, nbits: int) -> Column:
    """Codes as bytes (array of ints), first component in the highest bits."""
    per = 8 // nbits
    groups = F.sequence(F.lit(0), (F.size(codes) / per).cast("int") - 1)

    def byte(g: Column) -> Column:
        out = F.lit(0)
        for i in range(per):
            out = F.shiftleft(out, nbits) + F.element_at(codes, (g * per + i + 1).cast("int")).cast("int")
        return out

    return F.transform(groups, byte)


def unpacked(data: Column, nbits: int) -> Column:
    per, mask = 8 // nbits, (1 << nbits) - 1
    return F.flatten(F.transform(data, lambda b: F.array(*[F.shiftrightunsigned(b, nbits * (per - 1 - i)).bitwiseAND(F.lit(mask)).cast("smallint") for i in range(per)])))


def reconstructed(cv: Column, codes: Column, weights: list[float], unit: bool = True) -> Column:
    out = add(cv, pick(weights, codes))
    return normalise(out) if unit else out


def cells(centroids: DataFrame, assigned: DataFrame) -> DataFrame:
    """centroids with size and start, the number of embeddings in the cells before."""
    sizes = assigned.groupBy("centroid_id").agg(F.count("*").alias("size"))
    out = centroids.select("centroid_id", "cv").join(sizes, "centroid_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    before = Window.orderBy("centroid_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    return out.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def postings(assigned: DataFrame, centroids: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Embeddings in the order of cell, document, position; embedding_pos is their rank over all cells. Ranks are counted
    within parts of a cell (documents by a block of their id) and, over one row for each part, between them, so that no
    window holds a whole cell. Vectors do not stay: a code and its centroid stand for them."""
    rows = residuals(assigned).withColumn("codes", quantise(F.col("r"), cutoffs)).drop("r", "v", "cv").withColumn("_d", F.floor(F.col("doc_id") / PART))
    parts = rows.groupBy("centroid_id", "_d").agg(F.count("*").alias("_k"))
    before = Window.partitionBy("centroid_id").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("centroid_id", "_d", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_b"))
    own = Window.partitionBy("centroid_id", "_d").orderBy("doc_id", "pos")
    rows = rows.withColumn("_n", F.row_number().over(own) - 1).join(parts, ["centroid_id", "_d"])
    return rows.join(centroids.select("centroid_id", "start"), "centroid_id").withColumn("embedding_pos", F.col("start") + F.col("_b") + F.col("_n")).drop("_n", "_b", "_d", "start")


def build(tokens: DataFrame, centroids: DataFrame, nbits: int = 4, heldout: Column | None = None, rows: int | None = None, codec: DataFrame | None = None) -> Index:
    """Index of tokens(vec_id, doc_id, pos, v) around given centroids; the codec is ``codec``, or measured on the tokens that
    ``heldout`` marks (default: the held-out ones of sample_split())."""
    at = assign(tokens, centroids, rows=rows)
    if codec is None:
        part = assign(sample_split(tokens).where("heldout").select("vec_id", "v"), centroids, rows=rows) if heldout is None else at.where(heldout)
        codec = codec_frame(residuals(part), nbits)
    codec_ = codec.first()  # 2 * 2**nbits numbers
    cutoffs, weights = list(codec_.cutoffs or []), list(codec_.weights or [])
    table = cells(centroids, at)
    return Index(postings(at, table, cutoffs), table, cutoffs, weights)


def integrity(index: Index) -> DataFrame:
    """One row: embeddings, sum of cell sizes, positions out of range or repeated."""
    n = index.postings.agg(F.count("*").alias("n_embeddings"), F.countDistinct("embedding_pos").alias("n_positions"), F.max("embedding_pos").alias("last_pos"))
    return n.crossJoin(index.centroids.agg(F.sum("size").alias("sum_sizes")))


def inverted_lists(posts: DataFrame) -> DataFrame:
    return posts.select("centroid_id", "doc_id").distinct()


def reverse_index(posts: DataFrame) -> DataFrame:
    """doc_id with its positions in ascending order."""
    return posts.groupBy("doc_id").agg(F.sort_array(F.collect_list("embedding_pos")).alias("positions"))


def position_to_centroid(positions: DataFrame, centroids: DataFrame, width: int = 1 << 16) -> DataFrame:
    """positions(embedding_pos) with the cell whose range holds them: an equi-join on range blocks, then the range."""
    block = lambda c: F.floor(c / width)
    spans = centroids.where("size > 0").select("centroid_id", "start", "size", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("size") - 1))).alias("_b"))
    out = positions.withColumn("_b", block(F.col("embedding_pos"))).join(spans, "_b")
    return out.where("embedding_pos >= start and embedding_pos < start + size").drop("_b", "start", "size")
