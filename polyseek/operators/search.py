"""The query path: routing to cells, token scores, imputed sums, ranking. Many queries at once, one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.vectors import dot, is_zero, pick, tie, total
from polyseek.functions.arrow import matrix as vector_matrix
from polyseek.operators import blocks, matrices, pairs
from polyseek.operators.index import BROADCAST_BYTES, CentroidMatrix, Index, centroid_matrix, reconstructed
from polyseek.plans.config import SearchConfig, t_prime
from polyseek.sources.scratch import stored

#: Tokens that probe a cell, on average, from which scores are counted by document: their rows would be so many times the postings.
SHARED = 16
#: Candidates from which a staged search counts the documents, to see whether its filters would keep all.
FEW = 10_000


def centroid_scores(qtok: DataFrame, centroids: DataFrame, rows: int | None = None) -> DataFrame:
    """query_id, q_token_id, centroid_id, size, score for every non-zero query token and every cell. ``rows``: cells, where known."""
    live = qtok.where(~is_zero(F.col("qv"))).select("query_id", "q_token_id", "qv")
    out = matrices.all_scores(live, centroids).join(centroids.select("centroid_id", "size"), "centroid_id")
    return out.select("query_id", "q_token_id", "centroid_id", "size", "score")


def routes(qtok: DataFrame, held: CentroidMatrix, nprobe: int, at: int, bound: int | None = None) -> DataFrame:
    """query_id, q_token_id, mse and probes (centroid_id, rank, score, size) of each non-zero query token: what probes()
    and missing_scores() say, by one matrix product for each batch, without a row for each token and cell."""
    shared = qtok.sparkSession.sparkContext.broadcast(held)  # centroid_matrix() has checked its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n = len(m.ids)
        k, last = min(nprobe, n), min(bound or n, n)
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                score = vector_matrix(batch.column(2), m.vectors.shape[1]) @ m.vectors.T
                order = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, : max(k, last)]  # ties: least id
                ranked = np.take_along_axis(score, order, axis=1)
                reached = np.cumsum(m.sizes[order], axis=1)[:, :last] >= at
                cut = np.where(reached.any(axis=1), reached.argmax(axis=1), last - 1)
                mse = ranked[np.arange(len(ranked)), cut] if at else np.zeros(len(ranked))
                flat = {"centroid_id": m.ids[order[:, :k]].ravel(), "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(ranked)), "score": ranked[:, :k].ravel(), "size": m.sizes[order[:, :k]].ravel()}
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ranked) + 1) * k, k, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in flat.values()], names=list(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mse), lists], names=["query_id", "q_token_id", "mse", "probes"])

    live = qtok.where(~is_zero(F.col("qv"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("q_token_id").cast("long").alias("q_token_id"), F.col("qv").cast("array<double>").alias("qv"))
    return live.mapInArrow(run, "query_id long, q_token_id long, mse double, probes array<struct<centroid_id:long,rank:int,score:double,size:long>>")


def probes(scores: DataFrame, nprobe: int) -> DataFrame:
    """The nprobe best cells of each token, rank from 1 (score, then least id)."""
    w = Window.partitionBy("query_id", "q_token_id").orderBy(tie(F.col("score")).desc(), "centroid_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nprobe)


def missing_scores(scores: DataFrame, at: int, bound: int | None = None) -> DataFrame:
    """Per token the score of the cell at which cumulated sizes reach ``at`` (0: none is imputed). Where they never do,
    that of the last cell considered."""
    w = Window.partitionBy("query_id", "q_token_id").orderBy(tie(F.col("score")).desc(), "centroid_id")
    s = scores.withColumn("rank", F.row_number().over(w)).withColumn("cum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if bound is not None:
        s = s.where(F.col("rank") <= bound)
    crossing = F.min(F.when(F.col("cum") >= at, F.struct("rank", "score")))
    last = F.max(F.struct("rank", "score"))
    value = F.lit(0.0) if at == 0 else F.coalesce(F.col("m.score"), F.col("l.score"))
    return s.groupBy("query_id", "q_token_id").agg(crossing.alias("m"), last.alias("l")).select("query_id", "q_token_id", value.alias("mse"))


def token_scores(qtok: DataFrame, routed: DataFrame, index: Index, centroid_only: bool = False, candidates: DataFrame | None = None, ranking: DataFrame | None = None) -> DataFrame:
    """Every embedding of a probed cell with its score for the token; candidates (doc_id) restricts the documents, ranking (query_id,
    doc_id) those of each query, whose rows alone are met then."""
    posts = index.postings.select("centroid_id", "doc_id", "embedding_pos", "codes")
    if candidates is not None:
        posts = posts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = routed.select("query_id", "q_token_id", "centroid_id", "rank", F.col("score").alias("cs"))
    if ranking is None:
        rows = rows.join(posts, "centroid_id")
    else:
        rows = rows.join(ranking.select("query_id", "doc_id").join(posts, "doc_id"), ["query_id", "centroid_id"])
    if centroid_only:
        return rows.withColumn("score", F.col("cs"))
    rows = rows.join(qtok.select("query_id", "q_token_id", "qv"), ["query_id", "q_token_id"])
    return rows.withColumn("score", F.col("cs") + dot(F.col("qv"), pick(index.weights, F.col("codes"))))


def winners(scored: DataFrame) -> DataFrame:
    """Per query token and document its best embedding: score, then better-ranked cell, then lower position."""
    best = F.max(F.struct(tie(F.col("score")).alias("t"), (-F.col("rank")).alias("r"), (-F.col("embedding_pos")).alias("p"), "score")).alias("b")
    return scored.groupBy("query_id", "q_token_id", "doc_id").agg(best).select(
        "query_id", "q_token_id", "doc_id", (-F.col("b.p")).alias("embedding_pos"), F.col("b.score").alias("score")
    )


def document_scores(won: DataFrame, missing: DataFrame) -> DataFrame:
    """Sum over a query's tokens of the observed or else the imputed score, and how many were observed."""
    every = missing.groupBy("query_id").agg(F.sum("mse").alias("all_mse"))
    rows = won.join(missing, ["query_id", "q_token_id"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("score") - F.col("mse")).alias("s"), F.count("*").alias("influential"))
    return rows.join(every, "query_id").select("query_id", "doc_id", (F.col("s") + F.col("all_mse")).alias("score"), "influential")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(tie(F.col("score")).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_scores(qtok: DataFrame, routed: DataFrame, index: Index, centroid_only: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """token_scores() from the blocks of the probed cells: only their folders are read, and of each block and token only the best
    embedding of a document becomes a row. routed should be a written table: its cells are counted first."""
    vectors = qtok.select(F.col("query_id").cast("long").alias("query_id"), F.col("q_token_id").cast("long").alias("q_token_id"), F.col("qv").cast("array<double>").alias("qv"))
    counts = [(r.centroid_id, r["count"]) for r in routed.groupBy("centroid_id").count().collect()]  # a row for each probed cell
    width = index.centroids.select(F.size("cv")).first()
    probes_ = routed.select("centroid_id", F.col("query_id").cast("long").alias("query_id"), F.col("q_token_id").cast("long").alias("q_token_id"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
    probes_ = probes_.join(vectors, ["query_id", "q_token_id"])
    rows = blocks.scored(probes_, counts, width[0] if width else 1, index.blocks, index.per_folder, index.weights, not centroid_only)
    return rows if candidates is None else rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")


def search(qtok: DataFrame, index: Index, config: SearchConfig, candidates: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """query_id, doc_id, rank, score, influential: the k best documents of each query.

    Routing is written out once. An index with blocks is read by the cells that were probed. Where their postings are each scored for
    more than ``SHARED`` tokens, or there are no blocks, postings are dealt by document and no score is shuffled (``pairs``)."""
    at = config.t_prime
    if at is None:
        n = index.centroids.agg(F.count("*"), F.sum("size")).first()
        at = t_prime(n[0], n[1] or 0, config.k)
    held = centroid_matrix(index.centroids)
    if held is not None:
        routed = stored(routes(qtok, held, config.nprobe, at, config.bound))
        missing = routed.select("query_id", "q_token_id", "mse")
        routed = routed.select("query_id", "q_token_id", F.inline("probes"))
    else:
        scores = stored(centroid_scores(qtok, index.centroids, rows))
        routed, missing = probes(scores, config.nprobe), missing_scores(scores, at, config.bound)
        routed = stored(routed) if index.blocks is not None else routed
    posts = index.postings if index.blocks is None else shared_postings(routed, index)
    if posts is None:
        return top_k(document_scores(winners(block_scores(qtok, routed, index, config.centroid_only, candidates)), missing), config.k)
    if candidates is not None:
        posts = posts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    docs, asked = pairs.document_blocks(index, posts, config.centroid_only), pairs.query_blocks(qtok, routed, missing)
    return top_k(pairs.document_scores(docs, asked, pairs.size_of(qtok), config.k), config.k)


def shared_postings(routed: DataFrame, index: Index) -> DataFrame | None:
    """The postings of the probed cells, from blocks, or None where they are scored for no more than ``SHARED`` tokens on average."""
    probed = routed.groupBy("centroid_id").agg(F.count("*").alias("n")).join(index.centroids.select("centroid_id", "size"), "centroid_id")
    cells = [(r.centroid_id, r.n, r["size"]) for r in probed.collect()]  # a row for each probed cell
    if sum(n * s for _, n, s in cells) <= SHARED * sum(s for _, _, s in cells):
        return None
    ids = [c for c, _, _ in cells]
    near = blocks.of_cells(index.blocks, ids, index.per_folder).join(F.broadcast(routed.select("centroid_id").distinct()) if 16 * len(ids) <= BROADCAST_BYTES else routed.select("centroid_id").distinct(), "centroid_id", "left_semi")
    return blocks.block_rows(near, index.nbits, index.centroids.select(F.size("cv")).first()[0])


def search_statistics(qtok: DataFrame, routed: DataFrame, won: DataFrame) -> DataFrame:
    """Per query: its tokens, distinct cells probed, token scores, documents seen. won: rows for each token and document, or for each
    query and document with ``influential``."""
    a = qtok.where(~is_zero(F.col("qv"))).groupBy("query_id").agg(F.count("*").alias("query_length"))
    b = routed.groupBy("query_id").agg(F.countDistinct("centroid_id").alias("n_clusters_selected"))
    n = (F.sum("influential"), F.count("*")) if "influential" in won.columns else (F.count("*"), F.countDistinct("doc_id"))
    c = won.groupBy("query_id").agg(n[0].alias("total_token_scores"), n[1].alias("unique_docs"))
    return a.join(b, "query_id", "left").join(c, "query_id", "left")


def exact_maxsim(qtok: DataFrame, tokens: DataFrame, form: str = "sum", rows: int | None = None) -> DataFrame:
    """Scores of all documents without an index. form: sum; relu (token maxima of at least 0); l2 (negative squared
    distance); mean (over non-zero query tokens)."""
    live = qtok.where(~is_zero(F.col("qv"))).select("query_id", "q_token_id", "qv")

    def score(best: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.maximum(best, 0) if form == "relu" else best, own, axis=1)
        return out / np.diff(np.append(own, len(ids))) if form == "mean" else out

    return pairs.exact(live, tokens, score, form)


def two_part_maxsim(qtok: DataFrame, tokens: DataFrame, first: int, keep: tuple[int, int]) -> DataFrame:
    """two_part_sum() of all documents, without a row for each token and document."""

    def score(best: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(best), len(own)))
        for j, (a, b) in enumerate(zip(own.tolist(), [*own[1:].tolist(), len(ids)], strict=True)):
            for part, k in ((ids[a:b] < first, keep[0]), (ids[a:b] >= first, keep[1])):
                out[:, j] += -np.sort(-best[:, a:b][:, part], axis=1)[:, :k].sum(axis=1)
        return out

    return pairs.exact(qtok, tokens, score)


def two_part_sum(best: DataFrame, first: int, keep: tuple[int, int]) -> DataFrame:
    """Sum of the keep[0] greatest maxima of the first tokens and the keep[1] greatest of the others."""
    part = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("score"))), asc=False)
    rows = best.groupBy("query_id", "doc_id").agg(part(F.col("q_token_id") < first).alias("a"), part(F.col("q_token_id") >= first).alias("b"))
    return rows.select("query_id", "doc_id", (total(F.slice("a", 1, keep[0])) + total(F.slice("b", 1, keep[1]))).alias("score"))


def translated(ranking: DataFrame, ids: DataFrame) -> DataFrame:
    """Internal doc_id replaced by the external one of ids(doc_id, external_id)."""
    return ranking.join(ids, "doc_id").drop("doc_id").withColumnRenamed("external_id", "doc_id")


# The older scorer in stages: candidate cells, two centroid-only filters, exact scores.


def stage_candidates(qtok: DataFrame, index: Index, ncells: int) -> DataFrame:
    """query_id, doc_id of documents in any of the ncells best cells of any token."""
    asked = pairs.query_blocks(qtok, _picked(qtok, index, ncells))
    return pairs.document_scores(pairs.document_blocks(index, centroid_only=True), asked, pairs.size_of(qtok)).select("query_id", "doc_id")


def _picked(qtok: DataFrame, index: Index, ncells: int) -> DataFrame:
    held = centroid_matrix(index.centroids)
    return probes(centroid_scores(qtok, index.centroids), ncells) if held is None else routes(qtok, held, ncells, 0).select("query_id", "q_token_id", F.inline("probes"))


def first_filter(qtok: DataFrame, index: Index, ncells: int, keep: int, threshold: float | None = None, posts: DataFrame | None = None) -> DataFrame:
    """stage_filter() of stage_candidates(), by blocks of documents and queries: candidates that do not stay never become rows. posts:
    the postings of the documents that may be candidates (default: all)."""
    live = qtok.where(~is_zero(F.col("qv")))
    asked = pairs.query_blocks(live, _picked(live, index, ncells))
    return _kept(pairs.approximate(pairs.document_blocks(index, posts, centroid_only=True), asked, pairs.size_of(live), keep, threshold), keep)


def _kept(out: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(tie(F.col("score")).desc(), F.col("doc_id").desc())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("query_id", "doc_id", "score")


def block_winners(qtok: DataFrame, routed: DataFrame, index: Index) -> DataFrame:
    """winners() from the blocks of the probed cells; by document where their scores would be many more than their postings."""
    posts = shared_postings(routed, index)
    if posts is None:
        return winners(block_scores(qtok, routed, index))
    return pairs.winners(pairs.document_blocks(index, posts), pairs.query_blocks(qtok, routed), pairs.size_of(qtok))


@dataclass(frozen=True)
class QueryMatrices:
    """The non-zero tokens of every query as one matrix with the rows of each."""

    vectors: np.ndarray
    span: dict[int, tuple[int, int]]


def query_matrices(qtok: DataFrame) -> QueryMatrices | None:
    """The tokens of all queries for a broadcast, or None where they are larger than ``BROADCAST_BYTES``."""
    live = qtok.where(~is_zero(F.col("qv"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("q_token_id").cast("long").alias("q_token_id"), F.col("qv").cast("array<double>").alias("qv"))
    n, width = matrices.sizes(live, "qv")
    if n * width * 8 > BROADCAST_BYTES:
        return None
    t = live.toArrow().sort_by([("query_id", "ascending"), ("q_token_id", "ascending")])
    ids = t.column("query_id").to_numpy()
    who, first = np.unique(ids, return_index=True)
    ends = [*first[1:].tolist(), len(ids)]
    return QueryMatrices(vector_matrix(t.column("qv").combine_chunks(), width), {int(w): (int(a), b) for w, a, b in zip(who, first, ends, strict=True)})


def _by_query(rows: DataFrame, held: QueryMatrices, score: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """query_id, doc_id, score of rows(query_id, doc_id, ...): score(tokens of the query, its rows) for runs of one query."""
    shared = rows.sparkSession.sparkContext.broadcast(held)  # query_matrices() has checked its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            q = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if int(q[a]) in m.span:
                    low, high = m.span[int(q[a])]
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score(m.vectors[low:high], part))], names=["query_id", "doc_id", "score"])

    first = [F.col(c).cast("long").alias(c) for c in ("query_id", "doc_id")]
    rest = [c for c in rows.columns if c not in ("query_id", "doc_id")]
    return rows.select(*first, *rest).sortWithinPartitions("query_id").mapInArrow(run, "query_id long, doc_id long, score double")


def _runs(lists: pa.ListArray) -> np.ndarray:
    """Where each list of a column begins in its flat values, counted from the first."""
    offsets = lists.offsets.to_numpy()
    return offsets[:-1] - offsets[0]


def _approximate(candidates: DataFrame, qtok: DataFrame, index: Index, threshold: float | None) -> DataFrame:
    """query_id, doc_id, score: the sum over tokens of the best centroid score among the document's cells, one matrix product for the
    candidates of a query that a task holds; no row for each token and cell."""
    centres, held = centroid_matrix(index.centroids), query_matrices(qtok)
    if centres is None or held is None:
        return _approximate_by_rows(candidates, centroid_scores(qtok, index.centroids), index, threshold)
    shared = qtok.sparkSession.sparkContext.broadcast(centres)  # at most BROADCAST_BYTES
    docs = index.postings.select("doc_id", F.col("centroid_id").cast("long").alias("centroid_id")).groupBy("doc_id").agg(F.collect_set("centroid_id").alias("cells"))  # as many as a document has tokens

    def score(q: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        c = shared.value
        cells, back = np.unique(part.column(2).flatten().to_numpy(), return_inverse=True)
        s = q @ c.vectors[np.searchsorted(c.ids, cells)].T
        if threshold is not None:
            s[:, s.max(axis=0) < threshold] = -np.inf
        best = np.maximum.reduceat(s[:, back], _runs(part.column(2)), axis=1)
        return np.where(np.isfinite(best), best, -9999.0).sum(axis=0)

    return _by_query(candidates.join(docs, "doc_id").select("query_id", "doc_id", "cells"), held, score)


def _approximate_by_rows(candidates: DataFrame, scores: DataFrame, index: Index, threshold: float | None) -> DataFrame:
    used = scores.select("query_id", "q_token_id", "centroid_id", "score")
    if threshold is not None:
        good = used.groupBy("query_id", "centroid_id").agg(F.max("score").alias("m")).where(F.col("m") >= threshold)
        used = used.join(good.select("query_id", "centroid_id"), ["query_id", "centroid_id"], "left_semi")
    docs = candidates.join(index.postings.select("doc_id", "centroid_id").distinct(), "doc_id")
    seen = docs.join(used, ["query_id", "centroid_id"]).groupBy("query_id", "doc_id", "q_token_id").agg(F.max("score").alias("s"))
    tokens = scores.select("query_id", "q_token_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    sums = seen.groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"), F.count("*").alias("seen"))
    out = candidates.join(sums, ["query_id", "doc_id"], "left").join(tokens, "query_id")
    return out.select("query_id", "doc_id", (F.coalesce("s", F.lit(0.0)) - F.lit(9999.0) * (F.col("n") - F.coalesce("seen", F.lit(0)))).alias("score"))


def stage_filter(candidates: DataFrame, qtok: DataFrame, index: Index, keep: int, threshold: float | None = None) -> DataFrame:
    """The keep best candidates by the sum over tokens of the best centroid score among the document's cells (with a
    threshold only cells whose best score over tokens reaches it; -9999 where none does). Ties: higher doc_id first."""
    return _kept(_approximate(candidates, qtok, index, threshold), keep)


def stage_scores(found: DataFrame, qtok: DataFrame, index: Index, relu: bool = True) -> DataFrame:
    """query_id, doc_id, score: MaxSim on the reconstructed, normalised vectors of each document found."""
    posts = index.of_documents(found).select("doc_id", F.col("centroid_id").cast("long").alias("centroid_id"), "codes")
    centres, held = centroid_matrix(index.centroids), query_matrices(qtok)
    if centres is None or held is None:
        v = posts.join(index.centroids.select("centroid_id", "cv"), "centroid_id").select("doc_id", reconstructed(F.col("cv"), F.col("codes"), index.weights).alias("v"))
        rows = found.join(v, "doc_id").join(qtok.where(~is_zero(F.col("qv"))).select("query_id", "q_token_id", "qv"), "query_id")
        best = rows.groupBy("query_id", "doc_id", "q_token_id").agg(F.max(dot(F.col("qv"), F.col("v"))).alias("s"))
        return best.groupBy("query_id", "doc_id").agg(F.sum(F.greatest(F.col("s"), F.lit(0.0)) if relu else F.col("s")).alias("score"))
    shared = qtok.sparkSession.sparkContext.broadcast(centres)  # at most BROADCAST_BYTES
    weights = np.array(index.weights)
    docs = posts.groupBy("doc_id").agg(F.collect_list(F.struct("centroid_id", "codes")).alias("t"))  # a document's tokens

    def score(q: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        c = shared.value
        tokens = part.column(2).flatten()
        cells, codes = tokens.field(0).to_numpy(), tokens.field(1)
        v = c.vectors[np.searchsorted(c.ids, cells)] + weights[codes.flatten().to_numpy().reshape(len(cells), -1)]
        size = np.linalg.norm(v, axis=1, keepdims=True)
        best = np.maximum.reduceat(q @ (v / np.where(size > 0, size, 1)).T, _runs(part.column(2)), axis=1)
        return (np.maximum(best, 0) if relu else best).sum(axis=0)

    return _by_query(found.join(docs, "doc_id").select("query_id", "doc_id", "t"), held, score)


def staged_search(qtok: DataFrame, index: Index, k: int, setting: tuple[int, float, int], candidates: DataFrame | None = None, relu: bool = True, allowed: Column | None = None) -> DataFrame:
    """Candidates, both filters, exact scores on reconstructed (normalised) vectors. candidates (query_id, doc_id) take
    the place of the first stage; of either only those go on for which ``allowed`` (of query_id, doc_id) holds."""
    ncells, threshold, ndocs = setting
    second = max(1, ndocs // 4)
    posts = _allowed_postings(index, allowed) if candidates is None else None
    if posts is not None:
        n = posts.select("doc_id").distinct().count() if allowed is not None or ndocs > FEW else second + 1
        if n <= second:  # both filters would keep every candidate: none becomes a row before its exact score
            live = qtok.where(~is_zero(F.col("qv")))
            asked = pairs.query_blocks(live, _picked(live, index, ncells))
            return top_k(pairs.stage_scores(pairs.document_blocks(index, posts), asked, pairs.size_of(live), k, relu), k)
        found = first_filter(qtok, index, ncells, ndocs, threshold, posts).select("query_id", "doc_id")
    else:
        found = candidates if candidates is not None else stage_candidates(qtok, index, ncells)
        found = found if allowed is None else found.where(allowed)
        found = stage_filter(found, qtok, index, ndocs, threshold).select("query_id", "doc_id")
    found = stored(stage_filter(found, qtok, index, second).select("query_id", "doc_id"))  # read twice
    return top_k(stage_scores(found, qtok, index, relu), k)


def _allowed_postings(index: Index, allowed: Column | None) -> DataFrame | None:
    """The postings of the documents for which ``allowed`` holds, or None where it asks for more than doc_id."""
    if allowed is None:
        return index.postings
    try:
        index.postings.select("doc_id").where(allowed).schema  # noqa: B018  resolves the names
    except AnalysisException:
        return None
    return index.postings.where(allowed)
