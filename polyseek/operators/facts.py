"""Fact tables of a measured search (M1, R0, M3, M4) and what is derived from them (M2, M5, M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.vectors import dot, pick, tie
from polyseek.operators import pairs, search
from polyseek.operators.index import BROADCAST_BYTES, Index, centroid_matrix
from polyseek.plans.config import SearchConfig, t_prime
from polyseek.sources.scratch import stored

TOKEN = ["query_id", "q_token_id"]


def near(rows: DataFrame) -> DataFrame:
    """rows of a few numbers, for a join with many more: broadcast if they fit ``BROADCAST_BYTES``."""
    return F.broadcast(rows) if rows.count() * 64 <= BROADCAST_BYTES else rows


def m1(routed: DataFrame) -> DataFrame:
    """Similarities computed for each token and probed cell: the cell's size; empty cells are left out."""
    return routed.where("size > 0").select(*TOKEN, "centroid_id", F.col("size").alias("num_token_token_sims"))


def r0(routed: DataFrame) -> DataFrame:
    return routed.select(*TOKEN, "centroid_id", (F.col("rank") - 1).alias("rank"), F.col("score").alias("centroid_score"))


def m3(won: DataFrame, ranking: DataFrame) -> DataFrame:
    """Winners of the ranked documents only."""
    rows = won.join(ranking.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return rows.select(*TOKEN, "doc_id", F.col("embedding_pos").alias("winner_embedding_pos"), F.col("score").alias("winner_score"))


def oracle_rows(qtok: DataFrame, won: DataFrame, index: Index) -> DataFrame:
    """Score of every embedding of every document that any token of the query touched."""
    scope = won.select("query_id", "doc_id").distinct()
    scope = stored(scope) if index.documents is not None else scope  # read twice there
    posts = scope.join(index.of_documents(scope).select("doc_id", "embedding_pos", "centroid_id", "codes"), "doc_id")
    tokens = qtok.select(*TOKEN, "qv")
    # The centroids' part once for each token and cell in scope, not once for each embedding.
    near = posts.select("query_id", "centroid_id").distinct().join(index.centroids.select("centroid_id", "cv"), "centroid_id").join(tokens, "query_id")
    near = near.select(*TOKEN, "centroid_id", dot(F.col("qv"), F.col("cv")).alias("_c"))
    rows = posts.join(tokens, "query_id").join(near, [*TOKEN, "centroid_id"])
    return rows.select(*TOKEN, "doc_id", "embedding_pos", "centroid_id", (F.col("_c") + dot(F.col("qv"), pick(index.weights, F.col("codes")))).alias("score"))


def oracle(qtok: DataFrame, routed: DataFrame, index: Index, scope: DataFrame | None = None, columns: tuple[str, ...] = ("oracle_embedding_pos", "oracle_score", "oracle_centroid_id")) -> DataFrame:
    """m4(oracle_rows()) by blocks of whole documents: no row for each embedding, and none is shuffled. scope (doc_id): the touched
    documents, where few are read."""
    docs = pairs.document_blocks(index, None if scope is None else index.of_documents(scope))
    asked = stored(pairs.query_blocks(qtok, routed))
    return pairs.measured(docs, asked, pairs.size_of(qtok), columns)


def m4(rows: DataFrame) -> DataFrame:
    """Per token and document the embedding of greatest score over all of the document's (ties: lowest position)."""
    best = F.max(F.struct(tie(F.col("score")).alias("t"), (-F.col("embedding_pos")).alias("p"), "score", "centroid_id")).alias("b")
    return rows.groupBy(*TOKEN, "doc_id").agg(best).select(*TOKEN, "doc_id", (-F.col("b.p")).alias("oracle_embedding_pos"), F.col("b.score").alias("oracle_score"), F.col("b.centroid_id").alias("oracle_centroid_id"))


def smart_skip_of(rows: DataFrame, margin: float = 0.01) -> DataFrame:
    """smart_skip() of measured rows (observed_score, other)."""
    out = rows.where("observed_score is not null").select(*TOKEN, "doc_id", F.col("observed_score").alias("observed"), "other")
    return out.withColumn("skipped", F.coalesce(F.col("observed") >= F.col("other") - margin, F.lit(True)))


def smart_skip(rows: DataFrame, won: DataFrame, margin: float = 0.01) -> DataFrame:
    """Whether a token's observed winner beats the best other embedding of the document, but for the margin."""
    seen = won.select(*TOKEN, "doc_id", F.col("embedding_pos").alias("seen_pos"), F.col("score").alias("seen_score"))
    out = rows.join(seen, [*TOKEN, "doc_id"]).groupBy(*TOKEN, "doc_id").agg(F.first("seen_score").alias("observed"), F.max(F.when(F.col("embedding_pos") != F.col("seen_pos"), F.col("score"))).alias("other"))
    return out.select(*TOKEN, "doc_id", "observed", "other", F.coalesce(F.col("observed") >= F.col("other") - margin, F.lit(True)).alias("skipped"))


def m2(m1_: DataFrame, m3_: DataFrame) -> DataFrame:
    a = m1_.groupBy("query_id").agg(F.sum("num_token_token_sims").alias("m1_total_sims"))
    b = m3_.groupBy("query_id").agg(F.count("*").alias("m3_influential_pairs"))
    out = a.join(b, "query_id", "full_outer").na.fill(0)
    out = out.withColumn("m2_redundant_sims", F.col("m1_total_sims") - F.col("m3_influential_pairs"))
    return out.withColumn("redundancy_rate", F.col("m2_redundant_sims") / F.nullif("m1_total_sims", F.lit(0)))


def m5(m4_: DataFrame, r0_: DataFrame, m3_: DataFrame | None = None, top_k_only: bool = False) -> DataFrame:
    """M4 with is_miss (the winner's cell was not probed for the token), unless it has it, and, with M3, the observed winner and the gap.
    M4 has far more rows than R0 and M3; these are broadcast while they are small."""
    keys, out = [*TOKEN, "doc_id"], m4_
    m3_ = near(m3_) if m3_ is not None else None
    if top_k_only:
        out = out.join(m3_.select(*keys), keys, "left_semi")
    if "is_miss" not in out.columns:
        hit = r0_.select(*TOKEN, F.col("centroid_id").alias("oracle_centroid_id"), F.lit(False).alias("_hit"))
        out = out.join(near(hit), [*TOKEN, "oracle_centroid_id"], "left").withColumn("is_miss", F.coalesce("_hit", F.lit(True))).drop("_hit")
    if m3_ is not None:
        seen = m3_.select(*keys, F.col("winner_embedding_pos").alias("observed_embedding_pos"), F.col("winner_score").alias("observed_score"))
        out = out.join(seen, keys, "left").withColumn("score_delta", F.col("oracle_score") - F.coalesce("observed_score", "oracle_score"))
    return out


def _counts(m5_: DataFrame) -> list:
    """Misses and wins of M5's rows, or of their counts (``pairs.misses``)."""
    if "oracle_win_count" in m5_.columns:
        return [F.sum(c).alias(c) for c in ("miss_count", "oracle_win_count")]
    return [F.count_if("is_miss").alias("miss_count"), F.count("*").alias("oracle_win_count")]


def m6(m5_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Misses and wins of each cell, over all queries or by query_id. m5_: its rows or their counts."""
    out = m5_.groupBy(*by, "oracle_centroid_id").agg(*_counts(m5_))
    return out.withColumn("miss_rate", F.col("miss_count") / F.col("oracle_win_count"))


def m6_both(m5_: DataFrame) -> DataFrame:
    """Both levels of M6 in one pass; query_id is null on rows over all queries."""
    out = m5_.groupingSets([[F.col("oracle_centroid_id")], [F.col("query_id"), F.col("oracle_centroid_id")]], F.col("query_id"), F.col("oracle_centroid_id"))
    out = out.agg(*_counts(m5_))
    return out.withColumn("miss_rate", F.col("miss_count") / F.col("oracle_win_count"))


# Golden documents: those with a relevance judgement.


def golden_m4(m4_: DataFrame, qrels: DataFrame, r0_: DataFrame, posts: DataFrame) -> DataFrame:
    """M4 rows of judged pairs with what routing reached: per token, and of the document by any token."""
    rows = m4_.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    docs = posts.groupBy("doc_id").agg(F.count("*").alias("num_doc_embeddings"), F.countDistinct("centroid_id").alias("num_doc_centroids"))
    own = r0_.select(*TOKEN, F.col("centroid_id").alias("oracle_centroid_id"), F.lit(True).alias("_own"))
    reached = posts.select("doc_id", "centroid_id").distinct().join(rows.select("query_id", "doc_id").distinct(), "doc_id")
    reached = reached.join(r0_.select("query_id", "centroid_id").distinct(), ["query_id", "centroid_id"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("num_accessible_centroids"))
    out = rows.join(docs, "doc_id").join(own, [*TOKEN, "oracle_centroid_id"], "left").join(reached, ["query_id", "doc_id"], "left")
    return out.select(
        *TOKEN, "doc_id", "oracle_embedding_pos", "oracle_score", "oracle_centroid_id", "num_doc_embeddings", "num_doc_centroids",
        F.coalesce("num_accessible_centroids", F.lit(0)).alias("num_accessible_centroids"), F.coalesce("_own", F.lit(False)).alias("oracle_is_accessible"),
        F.col("num_accessible_centroids").isNotNull().alias("any_embedding_accessible"), *[c for c in ("n_probed", "best_probed") if c in m4_.columns],
    )


#: What blocks of judged documents tell of each beside M4's columns.
GOLDEN = ("num_doc_embeddings", "num_doc_centroids", "num_accessible_centroids")


def golden_rows(rows: DataFrame) -> DataFrame:
    """golden_m4() of rows that blocks of judged documents gave (is_miss, ``GOLDEN``)."""
    reached = F.col("num_accessible_centroids") > 0
    return rows.select(*[c for c in rows.columns if c != "is_miss"], (~F.col("is_miss")).alias("oracle_is_accessible"), reached.alias("any_embedding_accessible"))


def routing_status(m4r: DataFrame) -> DataFrame:
    """m4r: rows of tokens, or a row for each query and document (``pairs.golden_documents``)."""
    out = m4r if "oracle_hits" in m4r.columns else m4r.groupBy("query_id", "doc_id").agg(
        F.count_if("oracle_is_accessible").alias("oracle_hits"), F.count("*").alias("num_tokens"), F.bool_or("any_embedding_accessible").alias("any_embedding_accessible"),
        F.max("num_doc_embeddings").alias("num_doc_embeddings"), F.max("num_doc_centroids").alias("num_doc_centroids"), F.max("num_accessible_centroids").alias("num_accessible_centroids"),
    )
    status = F.when(~F.col("any_embedding_accessible"), "mse_only").when(F.col("oracle_hits") == F.col("num_tokens"), "fully_optimal").otherwise("partial")
    return out.withColumn("routing_status", status).withColumn("oracle_hit_rate", F.col("oracle_hits") / F.col("num_tokens")).withColumn(
        "centroid_coverage", F.least(F.lit(1.0), F.col("num_accessible_centroids") / F.nullif("num_doc_centroids", F.lit(0)))
    )


def m6r(qrels: DataFrame, posts: DataFrame, r0_: DataFrame) -> DataFrame:
    """Cells of judged documents that no token of the query probed; queries without routing are skipped."""
    pairs = qrels.select("query_id", "doc_id").distinct().join(r0_.select("query_id").distinct(), "query_id", "left_semi")
    rows = pairs.join(posts.select("doc_id", "centroid_id").distinct(), "doc_id")
    n = rows.groupBy("query_id", "doc_id").agg(F.count("*").alias("num_doc_centroids"))
    missed = rows.join(r0_.select("query_id", "centroid_id").distinct(), ["query_id", "centroid_id"], "left_anti")
    k = missed.groupBy("query_id", "doc_id").agg(F.count("*").alias("num_missed"))
    return missed.join(n, ["query_id", "doc_id"]).join(k, ["query_id", "doc_id"]).select("query_id", "doc_id", F.col("centroid_id").alias("missed_centroid_id"), "num_doc_centroids", "num_missed")


def recall_by(status: DataFrame, ranking: DataFrame, by: str) -> DataFrame:
    found = ranking.select("query_id", "doc_id", F.lit(1).alias("_f"))
    out = status.join(found, ["query_id", "doc_id"], "left").groupBy(by).agg(F.count("*").alias("pairs"), F.count("_f").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("pairs"))


#: Right ends of the hit-rate bins.
HIT_BINS = (0.5, 0.7, 0.8, 0.9, 0.95, 1.0)


def hit_rate_bin(status: DataFrame) -> DataFrame:
    bin_ = F.lit(None).cast("double")
    for edge in reversed(HIT_BINS):
        bin_ = F.when(F.col("oracle_hit_rate") <= edge, F.lit(edge)).otherwise(bin_)
    return status.withColumn("hit_bin", bin_)


def rescue(status: DataFrame, ranking: DataFrame) -> DataFrame:
    """How retrieved but not fully routed documents were found: by a reachable oracle winner, or without any."""
    got = status.where("routing_status = 'partial'").join(ranking.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return got.groupBy(F.when(F.col("oracle_hits") > 0, "lucky_oracle").otherwise("non_oracle_rescue").alias("mechanism")).agg(F.count("*").alias("pairs"))


def fallback(m4r: DataFrame, rows: DataFrame, r0_: DataFrame) -> DataFrame:
    """For judged rows whose oracle cell was not probed: probed embeddings of the document for the token, the best
    of their scores, the relative gap (0 where the oracle's is not positive) and its class."""
    miss = m4r.where("not oracle_is_accessible").select(*TOKEN, "doc_id", "oracle_score")
    probed = rows.join(r0_.select(*TOKEN, "centroid_id"), [*TOKEN, "centroid_id"], "left_semi").groupBy(*TOKEN, "doc_id").agg(F.count("*").alias("num_fallback"), F.max("score").alias("best_accessible"))
    return _graded(miss.join(probed, [*TOKEN, "doc_id"], "left").withColumn("num_fallback", F.coalesce("num_fallback", F.lit(0))))


def fallback_of(m4r: DataFrame) -> DataFrame:
    """fallback() of judged rows that know their probed embeddings (n_probed, best_probed)."""
    rows = m4r.where("not oracle_is_accessible") if "oracle_is_accessible" in m4r.columns else m4r  # else misses alone
    return _graded(rows.select(*TOKEN, "doc_id", "oracle_score", F.col("n_probed").alias("num_fallback"), F.col("best_probed").alias("best_accessible")))


def _graded(out: DataFrame) -> DataFrame:
    gap = F.when(F.col("oracle_score") > 0, (F.col("oracle_score") - F.col("best_accessible")) / F.col("oracle_score")).otherwise(F.when(F.col("best_accessible").isNotNull(), 0.0))
    out = out.withColumn("relative_gap", gap)
    return out.withColumn("strength", F.when(F.col("relative_gap").isNull(), "none").when(F.col("relative_gap") < 0.05, "strong").when(F.col("relative_gap") < 0.2, "moderate").otherwise("weak"))


def centroid_spread(rows: DataFrame, r0_: DataFrame, k: float = 1.5) -> DataFrame:
    """Per token and document: embeddings within k population deviations of its best score, the cells they are in, and
    the share of them in probed cells."""
    w = Window.partitionBy(*TOKEN, "doc_id")
    s = rows.withColumn("_m", F.max("score").over(w)).withColumn("_d", F.stddev_pop("score").over(w)).where(F.col("score") >= F.col("_m") - k * F.col("_d"))
    s = s.join(r0_.select(*TOKEN, "centroid_id", F.lit(1).alias("_p")), [*TOKEN, "centroid_id"], "left")
    return s.groupBy(*TOKEN, "doc_id").agg(F.count("*").alias("strong"), F.countDistinct("centroid_id").alias("strong_centroids"), (F.count("_p") / F.count("*")).alias("capture_rate"))


#: Pairs up to which a golden scan filters by a bit table before its join, and bits of the table for each of them.
GOLDEN_MOST, GOLDEN_BITS = 1 << 22, 16


def golden_scan(m4_: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rows of M4 whose (query_id, doc_id) is judged, in two stages: a Bloom filter of two hashes over the pairs, one row that is
    broadcast to the scan (at most ``GOLDEN_BITS`` bits for each of ``GOLDEN_MOST`` pairs), then the exact semi join of what is left.
    Of a large M4 only rows of judged pairs, and a few others, are shuffled."""
    pairs = qrels.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = pairs.count()
    if not n:
        return m4_.where(F.lit(False))
    keys = [F.col("query_id").cast("long"), F.col("doc_id").cast("long")]
    if n <= GOLDEN_MOST:
        words = max(1, -(-n * GOLDEN_BITS // 64))
        at = [F.pmod(h, F.lit(64 * words)) for h in (F.xxhash64(*keys), F.xxhash64(F.lit(7), *keys))]
        bits = pairs.select(F.explode(F.array(*at)).alias("b")).groupBy(F.expr("b div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("w"))
        bits = m4_.sparkSession.range(words).select(F.col("id").alias("i")).join(bits, "i", "left").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("s"))
        bits = bits.select(F.col("s.w").alias("_bits"))  # one row of ``words`` numbers
        m4_ = m4_.crossJoin(F.broadcast(bits))
        for a in at:
            m4_ = m4_.where(F.getbit(F.get("_bits", F.floor(a / 64).cast("int")), (a % 64).cast("int")) == 1)
        m4_ = m4_.drop("_bits")
    return m4_.join(pairs, ["query_id", "doc_id"], "left_semi")


def measure(qtok: DataFrame, index: Index, config: SearchConfig) -> dict[str, DataFrame]:
    """m1, r0, m3, m4 and ranking of a search, each a plan over stored routes and winners."""
    at = config.t_prime
    if at is None:
        n = index.centroids.agg(F.count("*"), F.sum("size")).first()
        at = t_prime(n[0], n[1] or 0, config.k)
    held = centroid_matrix(index.centroids)
    if held is not None:
        rows = stored(search.routes(qtok, held, config.nprobe, at, config.bound))
        routed, missing = rows.select(*TOKEN, F.inline("probes")), rows.select(*TOKEN, "mse")
    else:
        scores = stored(search.centroid_scores(qtok, index.centroids))
        routed, missing = stored(search.probes(scores, config.nprobe)), search.missing_scores(scores, at, config.bound)
    if index.blocks is not None and search.shared_postings(routed, index) is None:
        won = stored(search.winners(search.block_scores(qtok, routed, index)))
        ranking = stored(search.top_k(search.document_scores(won, missing), config.k))
        scope = stored(won.select("doc_id").distinct())
    else:
        asked, size = stored(pairs.query_blocks(qtok, routed, missing)), pairs.size_of(qtok)
        ranking = stored(search.top_k(pairs.document_scores(pairs.document_blocks(index), asked, size, config.k), config.k))
        won, scope = search.winners(search.token_scores(qtok, routed, index, ranking=ranking)), None
    return {"m1": m1(routed), "r0": r0(routed), "m3": m3(won, ranking), "m4": oracle(qtok, routed, index, scope), "ranking": ranking}
