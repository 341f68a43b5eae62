"""Whole documents against whole queries: blocks give what rows of tokens and embeddings give, and no pair is shuffled."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseek.operators import clusters, facts, index, matrices, pairs, search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*[F.round(c, 6) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes]).collect()), key=repr)


@pytest.fixture(scope="module")
def parts(spark):
    v = np.random.default_rng(5).normal(size=(400, 12))
    tokens = spark.createDataFrame([(i, i // 5, i % 5, x) for i, x in enumerate(v.tolist())], "vec_id long, doc_id long, pos long, v array<double>").cache()
    seeds = tokens.where("vec_id < 20").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv"))
    built = index.build(tokens, seeds, 4, heldout=F.lit(True))
    built = index.Index(built.postings.cache(), built.centroids.cache(), built.cutoffs, built.weights)
    q = tokens.where("vec_id % 9 = 0").select((F.col("vec_id") % 7).alias("query_id"), F.col("vec_id").alias("q_token_id"), F.col("v").alias("qv")).cache()
    scores = search.centroid_scores(q, built.centroids)
    return tokens, built, q, search.probes(scores, 3).cache(), search.missing_scores(scores, 20).cache()


@pytest.mark.parametrize("small", [True, False])
def test_blocks_give_what_rows_give(spark, parts, monkeypatch, small):
    monkeypatch.setattr(pairs, "ROWS", 23)
    monkeypatch.setattr(pairs, "TOKENS", 6)
    if not small:
        monkeypatch.setattr(matrices, "BROADCAST_BYTES", 0)  # both sides shuffled, in groups
        monkeypatch.setattr(matrices, "GROUPS", 3)
    tokens, built, q, routed, missing = parts
    met = pairs.document_blocks(built), pairs.query_blocks(q, routed, missing), pairs.size_of(q)
    won = search.winners(search.token_scores(q, routed, built)).cache()
    every = facts.oracle_rows(q, won, built).cache()
    key = ("query_id", "q_token_id", "doc_id")
    assert rows_of(pairs.winners(*met), *key, "embedding_pos", "score") == rows_of(won, *key, "embedding_pos", "score")
    docs = search.document_scores(won, missing)
    assert rows_of(pairs.document_scores(*met), *docs.columns) == rows_of(docs, *docs.columns)
    top = search.top_k(docs, 4)
    assert rows_of(search.top_k(pairs.document_scores(*met, 4), 4), "query_id", "doc_id", "rank", "score") == rows_of(top, "query_id", "doc_id", "rank", "score")
    m4 = facts.m4(every)
    assert rows_of(pairs.measured(*met, m4.columns[3:]), *m4.columns) == rows_of(m4, *m4.columns)
    r0 = facts.r0(routed)
    m3 = facts.m3(search.winners(search.token_scores(q, routed, built, ranking=top)), top)
    assert rows_of(m3, *m3.columns) == rows_of(facts.m3(won, top), *m3.columns)
    m5 = facts.m5(m4, r0, m3)
    fast = facts.m5(pairs.measured(*met, (*m4.columns[3:], "is_miss")), r0, m3)
    assert rows_of(fast, *m5.columns) == rows_of(m5, *m5.columns)
    skip = facts.smart_skip(every, won)
    assert rows_of(facts.smart_skip_of(pairs.measured(*met, ("observed_score", "other"))), *skip.columns) == rows_of(skip, *skip.columns)
    spread = facts.centroid_spread(every, r0)
    got = pairs.measured(*met, ("strong", "strong_centroids", "strong_probed")).withColumn("capture_rate", F.col("strong_probed") / F.col("strong"))
    assert rows_of(got, *spread.columns) == rows_of(spread, *spread.columns)
    sums = m4.groupBy("query_id", "doc_id").agg(F.sum("oracle_score").alias("score"), F.countDistinct("oracle_centroid_id").alias("cells"))
    assert rows_of(pairs.oracle_documents(*met), *sums.columns) == rows_of(sums, *sums.columns)


def test_exact_scores_in_blocks(spark, parts, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS", 23)
    monkeypatch.setattr(pairs, "TOKENS", 6)
    tokens, _, q, _, _ = parts
    best = matrices.token_maxima(q, tokens)
    for form, one in (("sum", F.sum("score")), ("mean", F.avg("score")), ("relu", F.sum(F.greatest("score", F.lit(0.0))))):
        want = best.groupBy("query_id", "doc_id").agg(one.alias("score"))
        assert rows_of(search.exact_maxsim(q, tokens, form), *want.columns) == rows_of(want, *want.columns)
    want = search.two_part_sum(best, 100, (2, 1))
    assert rows_of(search.two_part_maxsim(q, tokens, 100, (2, 1)), *want.columns) == rows_of(want, *want.columns)


def test_no_pair_is_shuffled_or_grouped(spark, parts):
    """Above the pairs of blocks there is no aggregate: before, a row for each token and document was shuffled."""
    tokens, built, q, _, _ = parts
    assert "Aggregate" not in plan(search.exact_maxsim(q, tokens)).split("Join")[0]
    found = plan(search.search(q, built, search.SearchConfig.of(nprobe=3, k=5, t_prime=20))).split("Join")[0]
    assert "Window" in found and "Aggregate" not in found


def test_a_number_that_is_none_and_a_long_document(spark, parts, monkeypatch):
    """A component that is no number makes its embedding the best, as in a max of the engine; a document is never cut."""
    monkeypatch.setattr(pairs, "ROWS", 3)
    tokens, _, q, _, _ = parts
    odd = tokens.withColumn("v", F.when(F.col("vec_id") == 7, F.transform("v", lambda x: F.lit(float("nan")))).otherwise(F.col("v")))
    seeds = tokens.where("vec_id < 4").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv"))
    codec = spark.createDataFrame([([-0.5, 0.0, 0.5], [-1.0, -0.2, 0.2, 1.0])], "cutoffs array<double>, weights array<double>")
    built = index.build(tokens, seeds, 2, codec=codec)
    hurt = q.withColumn("qv", F.when(F.col("q_token_id") == 9, F.transform("qv", lambda x: F.lit(float("nan")))).otherwise(F.col("qv")))
    routed = search.probes(search.centroid_scores(hurt, built.centroids), 2)
    met = pairs.document_blocks(built), pairs.query_blocks(hurt, routed), pairs.size_of(hurt)
    assert pairs.winners(*met).count() == search.winners(search.token_scores(hurt, routed, built)).count()
    assert search.exact_maxsim(q, odd).where("doc_id = 1 and not isnan(score)").count() == 0


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_the_first_filter_by_blocks(spark, parts, monkeypatch, threshold):
    """The kept candidates are those that a row for each candidate gives, and none passes an aggregate above the pairs."""
    monkeypatch.setattr(pairs, "ROWS", 23)
    monkeypatch.setattr(pairs, "TOKENS", 6)
    _, built, q, _, _ = parts
    picked = search.probes(search.centroid_scores(q, built.centroids), 2).select("query_id", "centroid_id").distinct()
    found = picked.join(built.postings.select("centroid_id", "doc_id"), "centroid_id").select("query_id", "doc_id").distinct()
    candidates = search.stage_candidates(q, built, 2)
    assert rows_of(candidates, "query_id", "doc_id") == rows_of(found, "query_id", "doc_id")
    assert "Aggregate" not in plan(candidates).split("Join")[0]
    want = search.stage_filter(found, q, built, 6, threshold)
    assert rows_of(search.first_filter(q, built, 2, 6, threshold), *want.columns) == rows_of(want, *want.columns)


def test_judgements_need_no_group_of_all_pairs(spark):
    """Judged pairs are not grouped: the aggregates lie below the join that makes them."""
    from pathlib import Path

    from polyseek.plans.fixture import Fixture

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    t = Fixture(spark, data)
    own = t.qtok.select("query_id", "label").distinct()
    want = t.tokens.join(own, "label").groupBy("query_id", "doc_id").agg(F.count("*").cast("int").alias("relevance")).where("relevance >= 3")
    assert rows_of(t.qrels, *want.columns) == rows_of(want, *want.columns)
    assert "Aggregate" not in plan(t.qrels).split("Join")[0]


def test_runs_of_unequal_length_reduce_in_order():
    """Runs go through first rows, second rows and so on: ties go to the lower rank, then to the first row."""
    at, n = np.array([0, 1, 4, 6]), 9
    x = np.array([[5.0, 1], [2, 7], [2, 7], [1, 0], [3, 3], [4, 3], [np.inf, 0], [0, -np.inf], [1, 2]])
    runs = pairs.Runs(at, n)
    for f in (np.maximum, np.add):
        assert (runs.reduce(f, x) == f.reduceat(x, at, axis=0)).all()
    assert runs.best(x).tolist() == [[0, 0], [1, 1], [5, 4], [6, 8]]
    rank = np.array([[1, 1], [3, 2], [2, 2], [1, 1], [9, 2], [9, 1], [1, 1], [1, 1], [1, 1]])
    assert runs.best(x, rank).tolist() == [[0, 0], [2, 1], [5, 5], [6, 8]]


@pytest.mark.parametrize("ndocs", [1 << 20, 16])  # filters that keep all, and such that do not
def test_documents_are_chosen_before_they_are_candidates(spark, parts, monkeypatch, ndocs):
    _, built, q, _, _ = parts
    setting = (2, -1.0, ndocs)
    of_pair = (F.col("doc_id") % 3 == 1) & (F.col("query_id") >= 0)
    want = rows_of(search.staged_search(q, built, 3, setting, allowed=of_pair), "query_id", "doc_id", "rank", "score")

    def never(*_):
        raise AssertionError("a row for each pair of a query and a candidate")

    monkeypatch.setattr(search, "stage_candidates", never)
    got = rows_of(search.staged_search(q, built, 3, setting, allowed=F.col("doc_id") % 3 == 1), "query_id", "doc_id", "rank", "score")
    assert got == want and got


def test_counts_leave_the_task_instead_of_rows(spark, parts, monkeypatch):
    """M5 by query and by cell, the places of ranked documents and judged rows, as from rows of tokens and documents."""
    monkeypatch.setattr(pairs, "ROWS", 90)
    monkeypatch.setattr(pairs, "TOKENS", 20)
    _, built, q, routed, missing = parts
    docs, size = pairs.document_blocks(built), pairs.size_of(q)
    met = docs, pairs.query_blocks(q, routed, missing), size
    top, r0 = search.top_k(pairs.document_scores(*met, 4), 4).cache(), facts.r0(routed)
    m4 = pairs.measured(*met, ("oracle_embedding_pos", "oracle_score", "oracle_centroid_id")).cache()
    m3 = facts.m3(search.winners(search.token_scores(q, routed, built, ranking=top)), top).cache()
    m5 = facts.m5(m4, r0, m3).cache()
    ranked = docs, pairs.query_blocks(q, routed, found=top.select("query_id", "doc_id")), size
    want = clusters.severity(m5)
    assert rows_of(clusters.severity(pairs.misses(*ranked, ("oracle_centroid_id",))), *want.columns) == rows_of(want, *want.columns)
    want = facts.m6(m5, ("query_id",))
    assert rows_of(facts.m6(pairs.misses(*ranked, ("query_id", "oracle_centroid_id")), ("query_id",)), *want.columns) == rows_of(want, *want.columns)
    one = q.select("query_id").distinct()
    want = clusters.query_frame(one, one, m5)
    assert rows_of(clusters.query_frame(one, one, pairs.misses(*ranked, ("query_id",))), *want.columns) == rows_of(want, *want.columns)
    own = m4.groupBy("query_id", "doc_id").agg(F.sum("oracle_score").alias("score")).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"])
    want = clusters.evidence_recall(m3, m4, (1, 2, 5))
    assert rows_of(clusters.evidence_recall(m3, pairs.oracle_places(docs, pairs.query_blocks(q, routed, found=own), size), (1, 2, 5)), *want.columns) == rows_of(want, *want.columns)
    qrels = m4.where("(doc_id + query_id) % 3 = 0").select("query_id", "doc_id").distinct().cache()
    golden = pairs.document_blocks(built, qrels=qrels), met[1], size
    want = facts.golden_m4(m4, qrels, r0, built.postings)
    got = facts.golden_rows(pairs.measured(*golden, ("oracle_embedding_pos", "oracle_score", "oracle_centroid_id", "is_miss", *facts.GOLDEN)))
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_spread_of_long_documents_and_of_what_is_no_number(spark, parts):
    """Documents in more than 64 cells, and a token whose scores are no numbers: before, none of its embeddings counted, and the share was
    a division by zero."""
    _, _, q, _, _ = parts
    v = np.random.default_rng(6).normal(size=(320, 12))
    rows = [(i, 0 if i < 160 else 1 if i < 163 else 2 + i % 30, i, x) for i, x in enumerate(v.tolist())]
    tokens = spark.createDataFrame(rows, "vec_id long, doc_id long, pos long, v array<double>")
    seeds = tokens.where("vec_id < 150").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv"))
    built = index.build(tokens, seeds, 2, codec=spark.createDataFrame([([-0.5, 0.0, 0.5], [-1.0, -0.2, 0.2, 1.0])], "cutoffs array<double>, weights array<double>"))
    hurt = q.withColumn("qv", F.when(F.col("q_token_id") == 9, F.transform("qv", lambda x: F.lit(float("nan")))).otherwise(F.col("qv"))).cache()
    routed = search.probes(search.centroid_scores(hurt, built.centroids), 40).cache()
    won = search.winners(search.token_scores(hurt, routed, built))
    want = facts.centroid_spread(facts.oracle_rows(hurt, won, built), facts.r0(routed), k=3.5)
    met = pairs.document_blocks(built), pairs.query_blocks(hurt, routed), pairs.size_of(hurt)
    got = pairs.measured(*met, ("strong", "strong_centroids", "strong_probed"), spread=3.5).withColumn("capture_rate", F.col("strong_probed") / F.col("strong"))
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert got.where("strong_centroids > 64").count() and got.where("q_token_id = 9 and strong > 1").count()
