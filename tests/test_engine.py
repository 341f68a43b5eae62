"""Hand-checkable cases, invariants, and every catalogue query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseek.functions import distributions
from polyseek.operators import clusters, evaluate, facts, hypotheses, index, search, statistics, text
from polyseek.plans import catalog, config
from polyseek.plans.fixture import CELLS, Fixture
from polyseek.sources import readers, sinks

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
there = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
# Cheap ones of every family; TWINS=all runs the whole catalogue.
SAMPLE = "collection_load page_escape query_tokens_truncate chunk_offsets batches set_operations assign_centroid kmeans_lloyd_2iter codec_quantiles pack_roundtrip embedding_to_centroid topn_probe missing_similarity l2_maxsim two_part_score search_topk search_with_pid_filter stage_filter2 oracle_smart_skip m5 m6_grouping_sets routing_status m6r centroid_spread gini_docs b5_isolation traffic_concentration hub_class evidence_recall query_frame ndcg_at_k map_at_k success_at_k quartile_bins describe_extended spearman kendall group_comparison chi_square_stat ols_slope pareto collection_tsv_roundtrip queries_json_scan qrels_json_translated top_candidates_scan answers_scan facts_resumed query_tokenise_marked doc_tokenise_marked grouper_padded zipstar_lists index_sample_split codec_heldout search_loaded_index index_metadata offline_flags quartile_bin_filled search_routes staged_predicate recall_chi_square".split()
NAMES = sorted(catalog.oracle_sql()) if os.environ.get("TWINS") == "all" else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@there
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_every_query_has_a_name_and_most_a_twin():
    assert len(catalog.queries()) > 160 and len(catalog.oracle_sql()) > len(catalog.queries()) - 8


@there
def test_probing_all_cells_equals_brute_force(spark):
    t = Fixture(spark, DATA)
    exact = search.winners(search.token_scores(t.qtok, search.probes(t.scores, CELLS), t.index))
    posts = t.index.postings.join(t.cells.select("centroid_id", "cv"), "centroid_id")
    want = posts.select("doc_id", index.reconstructed(F.col("cv"), F.col("codes"), t.index.weights, unit=False).alias("v")).crossJoin(t.qtok)
    want = want.groupBy("query_id", "q_token_id", "doc_id").agg(F.max(search.dot(F.col("qv"), F.col("v"))).alias("w"))
    assert exact.join(want, ["query_id", "q_token_id", "doc_id"]).where(F.abs(F.col("score") - F.col("w")) > 1e-9).count() == 0
    assert exact.count() == want.count()


@there
def test_invariants(spark):
    t = Fixture(spark, DATA)
    n = t.tokens.count()
    one = index.integrity(t.index).first()
    assert one.n_embeddings == one.n_positions == one.sum_sizes == n and one.last_pos == n - 1
    m5 = t.m5.cache()
    m6 = facts.m6(m5).agg(F.sum("miss_count"), F.sum("oracle_win_count"), F.max("miss_rate")).first()
    assert m6[0] == m5.where("is_miss").count() and m6[1] == m5.count() and m6[2] <= 1
    assert m5.where("score_delta < -1e-9").count() == 0
    both = t.m3.groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).join(t.top, ["query_id", "doc_id"])
    assert both.where("c <> influential").count() == 0


@there
def test_index_round_trip(spark, tmp_path):
    t = Fixture(spark, DATA)
    t.index.save(str(tmp_path / "index"))
    again = index.Index.load(spark, str(tmp_path / "index"))
    assert again.weights == t.index.weights and again.postings.count() == t.tokens.count()
    assert sinks.index_bytes(spark, str(tmp_path / "index")) > 0


def test_imputation(spark):
    won = spark.createDataFrame([(0, 0, 1, 0, 0.9), (0, 1, 2, 1, 0.4), (0, 0, 3, 2, 0.6), (0, 1, 3, 3, 0.3)], "query_id long, q_token_id long, doc_id long, embedding_pos long, score double")
    missing = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.2)], "query_id long, q_token_id long, mse double")
    top = search.top_k(search.document_scores(won, missing), 3).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 9), r.influential) for r in top] == [(1, 1.1, 1), (2, 0.9, 1), (3, 0.9, 2)]


@pytest.mark.parametrize(("at", "want"), [(0, 0.0), (30, 0.9), (31, 0.8), (80, 0.8), (81, 0.7), (999, 0.7)])
def test_missing_score_walk(spark, at, want):
    scores = spark.createDataFrame([(0, 0, c, s, v) for c, s, v in ((5, 30, 0.9), (2, 50, 0.8), (9, 40, 0.7))], "query_id long, q_token_id long, centroid_id long, size long, score double")
    assert search.missing_scores(scores, at).first().mse == want


def test_settings():
    assert [config.t_prime(16, n, 10) for n in (124_999, 125_000, 12_500_000)] == [0, 1000, 10_000]
    assert [config.t_prime(1 << 17, 1, k) for k in (100, 101)] == [50_000, 100_000]
    assert [config.stage_defaults(k) for k in (10, 100, 2000)] == [(1, 0.5, 256), (2, 0.45, 1024), (4, 0.4, 8000)]
    a = config.SearchConfig.of(nprobe=8).merged(config.SearchConfig.of(k=5))
    assert (a.nprobe, a.k, a.nbits) == (8, 5, 4)
    assert len(config.grid(a=[1, 2], b=[3, 4, 5])) == 6 and config.sample_size(1) == 1 and config.partitions(500) == 256


def test_codes(spark):
    one = spark.range(1).select(
        index.quantise(F.array(*[F.lit(x) for x in (-1.0, -0.5, 0.0, 0.5, 1.0, 2.0)]), [-1.0, 0.0, 1.0]).alias("q"),
        index.packed(F.array(F.lit(11), F.lit(4)), 4).alias("four"), index.packed(F.array(*map(F.lit, (2, 3, 1, 0))), 2).alias("two"),
        index.unpacked(F.array(F.lit(180)), 2).alias("back"),
    ).first()
    assert one.q == [0, 1, 1, 2, 2, 3] and one.four == [180] and one.two == [180] and one.back == [2, 3, 1, 0]


def test_reverse_index(spark):
    rows = spark.createDataFrame(list(enumerate([7, 7, 12, 12, 3, 3, 55, 55, 99, 7, 101])), "embedding_pos long, doc_id long")
    got = {r.doc_id: r.positions for r in index.reverse_index(rows).collect()}
    assert got[7] == [0, 1, 9] and got[3] == [4, 5]


def test_gini_and_entropy(spark):
    rows = spark.createDataFrame([("a", 1)] * 4 + [("b", 0)] * 3 + [("b", 4), ("c", 5), ("z", 0)], "g string, n long")
    assert {r.g: round(r.gini, 9) for r in clusters.gini(rows, ["g"], "n").collect()} == {"a": 0, "b": 0.75, "c": 0, "z": 0}
    got = {r.g: (round(r.entropy, 9), r.normalized_entropy) for r in clusters.entropy(rows, ["g"], "n").collect()}
    assert got["a"][0] == round(math.log(4), 9) and abs(got["a"][1] - 1) < 1e-12 and got["c"] == (0, 0)


def test_redundancy_and_recall(spark):
    m1 = spark.createDataFrame([(0, 60), (0, 40), (1, 5)], "query_id long, num_token_token_sims long")
    m3 = spark.createDataFrame([(0,)] * 7, "query_id long")
    got = {r.query_id: (r.m2_redundant_sims, r.redundancy_rate) for r in facts.m2(m1, m3).collect()}
    assert got == {0: (93, 0.93), 1: (5, 1.0)}
    obs = spark.createDataFrame([(0, d, s) for d, s in ((1, 3.0), (2, 2.0), (3, 1.0))], "query_id long, doc_id long, winner_score double")
    orc = spark.createDataFrame([(0, d, s) for d, s in ((1, 3.0), (3, 2.0), (2, 1.0))], "query_id long, doc_id long, oracle_score double")
    assert clusters.evidence_recall(obs, orc, (2,)).first().recall_at_2 == 0.5


def test_relu(spark):
    q = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "query_id long, q_token_id long, qv array<double>")
    d = spark.createDataFrame([(0, 0, [0.3, -0.2])], "vec_id long, doc_id long, v array<double>")
    assert round(search.exact_maxsim(q, d, "relu").first().score, 9) == 0.3 and round(search.exact_maxsim(q, d).first().score, 9) == 0.1


def test_evaluation(spark):
    ranking = spark.createDataFrame([("q", d, s) for d, s in ((1, 3.0), (2, 2.0), (3, 1.0))], "query_id string, doc_id long, score double")
    qrels = spark.createDataFrame([("q", 1, 1), ("q", 3, 2), ("r", 9, 1)], "query_id string, doc_id long, relevance int")
    ndcg = {r.query_id: r.ndcg_5 for r in evaluate.ndcg_at(ranking, qrels).collect()}
    assert abs(ndcg["q"] - (1 + 2 / 2) / (2 + 1 / math.log2(3))) < 1e-12 and ndcg["r"] == 0
    assert {r.query_id: r.map_5 for r in evaluate.map_at(ranking, qrels).collect()} == {"q": (1 + 2 / 3) / 2, "r": 0}
    one = evaluate.success_at(ranking, qrels.select("query_id", "doc_id")).first()
    assert one.success_5 == 0.5 and one.recall_5 == 1
    assert evaluate.mean_metrics(evaluate.recall_at(ranking, qrels)).first().recall_5 == 0.5


def test_distributions():
    for got, want in (
        (distributions.normal_sf(1.959963985), 0.025), (distributions.t_two_sided(2.228138852, 10), 0.05), (distributions.chi2_sf(3.841458821, 1), 0.05),
        (distributions.chi2_sf(18.30703805, 10), 0.05), (distributions.t_two_sided(1.0, 1), 0.5), (distributions.beta_inc(2, 3, 0.5), 0.6875),
    ):
        assert abs(got - want) < 1e-8
    assert distributions.correlation_p(0.0, 10) == 1


def test_rules():
    mean, lo, hi = statistics.bootstrap_ci([1.0, 2.0, 3.0, 4.0])
    assert lo <= mean <= hi
    assert statistics.bootstrap_comparison([5.0, 6, 7], [1.0, 2, 3])[1] == 0
    assert statistics.bootstrap_spearman(list(range(20)), list(range(20))) == pytest.approx((1.0, 1.0), abs=1e-9)
    assert abs(statistics.proportion_test(60, 100)[0] - 2) < 1e-12
    assert 0 < statistics.mann_whitney_p(10.0, 5, 5) <= 1


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("0\ta\\nb\tT\n1\tplain\n")
    rows = readers.collection(spark, str(tmp_path / "c.tsv"))
    assert [(r.pid, r.text) for r in rows.orderBy("pid").collect()] == [(0, "T | a\nb"), (1, "plain")]
    assert readers.misnumbered(rows).count() == 0 and readers.misnumbered(rows.union(rows)).count() == 2
    sinks.save_collection(rows, str(tmp_path / "out"))
    assert readers.collection(spark, str(tmp_path / "out")).where("pid = 0").first().text == "T | a\nb"
    (tmp_path / "q.json").write_text('{"qid": "7", "question": "why"}\n{"_id": "8", "text": "how"}\n')
    assert {tuple(r) for r in readers.queries(spark, str(tmp_path / "q.json")).collect()} == {("7", "why"), ("8", "how")}
    (tmp_path / "r.json").write_text('{"1": {"a": 1, "b": 2}, "x": {"c": 0}}')
    (tmp_path / "m.json").write_text('{"5": "a", "6": "c"}')
    got = readers.translated_qrels(readers.qrels_json(spark, str(tmp_path / "r.json")), readers.id_map(spark, str(tmp_path / "m.json")))
    assert {(r.query_id, r.doc_id, r.relevance, r.query_num) for r in got.collect()} == {("1", 5, 1, 1), ("x", 6, 0, None)}
    (tmp_path / "f.tsv").write_text("1\t0\t4\t1\n1\t0\t4\t1\n2\t0\t5\t0\n")
    assert [tuple(r) for r in readers.qrels_four(spark, str(tmp_path / "f.tsv")).collect()] == [("1", "4", 1)]
    (tmp_path / "a.json").write_text('{"qid": 3, "answer_pids": [1, 1, 2]}\n')
    assert readers.answers(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "k.tsv").write_text("1\t5\tq\tp5\n1\t4\tq\tp4\n")
    assert [c.pid for c in readers.top_candidates(spark, str(tmp_path / "k.tsv")).first().candidates] == [4, 5]
    ranking = spark.createDataFrame([("1", 4, 1, 0.5)], "query_id string, doc_id long, rank int, score double")
    sinks.save_ranking(ranking, str(tmp_path / "rank"), {"nprobe": 4})
    assert readers.ranking(spark, str(tmp_path / "rank")).first().score == 0.5
    assert sinks.pending(spark.createDataFrame([("1",), ("2",)], "query_id string"), ranking).first().query_id == "2"


def test_reports():
    """Decision rules at their bounds, on a few numbers."""
    a, b = np.array([0.5, 0.6, 0.7, 0.8]), np.array([0.1, 0.2, 0.3, 0.2])
    u, p = statistics.mann_whitney(a, b)
    assert u == 16 and 0.005 < p < 0.03 and statistics.mann_whitney(b, a)[1] > 0.97


def test_report_rules(spark):
    rows = [(i, 100 + i, 10 + 2 * i, i / 30, 0.5 + i / 100, i / 40, i, i / 50, 100, 5 + i, i) for i in range(30)]
    names = "centroid_id long, n_tokens long, n_docs long, yield double, redundancy double, dispersion double, sel_freq long, m6_miss_rate double, m1_sims long, miss_count long, x long"
    frame = spark.createDataFrame(rows, names).withColumn("top_1_doc_share", F.col("yield")).withColumn("gini_coefficient", F.col("dispersion"))
    assert hypotheses.diversity_yield(frame)[1:3] == (True, 1.0) and hypotheses.dispersion_misses(frame)[1] and hypotheses.hubness_redundancy(frame)[1]
    assert hypotheses.concentration_redundancy(frame)[1] and not hypotheses.concentration_redundancy(frame.withColumn("m1_sims", F.when(F.col("yield") > 0.5, 1).otherwise(1000)))[1]
    few = hypotheses.diversity_yield(frame.limit(9))
    assert not few[1] and few[4] == 9  # fewer than ten rows support nothing
    bad = frame.select(F.col("centroid_id").alias("oracle_centroid_id"), (F.col("x") * 2.0).alias("mean_score_delta"))
    assert hypotheses.miss_severity(frame, bad)[1:3] == (True, 1.0) and hypotheses.miss_severity(frame, bad.limit(0))[1]
    assert not hypotheses.borderline_misses(frame)[1] and hypotheses.borderline_misses(frame.withColumn("m6_miss_rate", 1 - F.col("m6_miss_rate")))[1]
    lost = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "num_fallback long")
    assert hypotheses.no_fallback(lost)[1:3] == (True, 0.8) and not hypotheses.no_fallback(lost.union(lost.where("num_fallback = 1")).union(lost.where("num_fallback = 1")))[1]
    status = spark.createDataFrame([(0, d, "fully_optimal" if d < 100 else "partial", int(d < 190)) for d in range(200)], "query_id long, doc_id long, routing_status string, oracle_hits int")
    top = spark.createDataFrame([(0, d) for d in [*range(99), *range(100, 150)]], "query_id long, doc_id long")
    got = hypotheses.recall_by_routing(status, top)
    assert got[1] and abs(got[2] - 0.49) < 1e-12 and got[3] < 1e-6
    three = status.union(status.limit(1).withColumn("routing_status", F.lit("mse_only")).withColumn("doc_id", F.lit(999).cast("long")))
    assert hypotheses.recall_by_routing(three, top)[1:4:2] == (False, 1.0)
    assert hypotheses.lucky_oracle(status, top)[1:3] == (True, 1.0)


def test_tokeniser(spark):
    one = spark.createDataFrame([("why is it so",)], "t string").withColumn("w", text.tokens(F.col("t"), 32))
    got = one.select(text.marked_query(F.col("w"), 10).alias("q"), text.marked_query(F.col("w"), 5).alias("short")).first()
    assert got.q == ["[CLS]", "[Q]", "why", "is", "it", "so", "[SEP]", "[MASK]", "[MASK]", "[MASK]"] and got.short == ["[CLS]", "[Q]", "why", "is", "[SEP]"]
    docs = spark.createDataFrame([(5, ["a"] * 4), (1, ["a"] * 9), (3, ["a"]), (2, [])], "k long, w array<string>")
    rows = {r.k: r for r in text.marked_documents(docs, "k", F.col("w"), 2).collect()}
    assert all(r.tokens[:2] == ["[CLS]", "[D]"] for r in rows.values())
    assert {k: (r.batch, r.slot, r.place, len(r.tokens)) for k, r in rows.items()} == {2: (0, 0, 1, 4), 3: (0, 1, 2, 4), 5: (1, 0, 3, 12), 1: (1, 1, 0, 12)}


def test_routes_equal_probes(spark):
    """Routing by matrix products and by rows agree, ties and cells that are never reached included."""
    c = spark.createDataFrame([(i, [float(i % 3), 1.0], 5 * (i % 4), 0) for i in range(9)], "centroid_id long, cv array<double>, size long, start long")
    q = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 0.0]), (1, 0, [-1.0, 2.0])], "query_id long, q_token_id long, qv array<double>")
    scores, held = search.centroid_scores(q, c), search.centroid_matrix(c)
    for at, bound in ((7, None), (0, None), (1000, None), (20, 3)):
        got = search.routes(q, held, 4, at, bound)
        flat = got.select("query_id", "q_token_id", F.inline("probes")).select("query_id", "q_token_id", "rank", "centroid_id", "size", "score")
        assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, search.probes(scores, 4).select("query_id", "q_token_id", "rank", "centroid_id", "size", "score").collect()))
        assert sorted((r.query_id, r.q_token_id, r.mse) for r in got.collect()) == sorted(map(tuple, search.missing_scores(scores, at, bound).collect()))


def test_assign_in_both_forms(spark, monkeypatch):
    v = spark.createDataFrame([(i, i // 5, [float(i % 7), 1.0, -float(i % 3)]) for i in range(60)], "vec_id long, doc_id long, v array<double>")
    c = v.where("vec_id < 9").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv"))
    one = sorted((r.vec_id, r.centroid_id) for r in index.assign(v, c).collect())
    monkeypatch.setattr(index, "BROADCAST_BYTES", 8)
    assert index.centroid_matrix(c) is None and sorted((r.vec_id, r.centroid_id) for r in index.assign(v, c).collect()) == one


def test_broken_index_is_found(spark, tmp_path):
    v = spark.createDataFrame([(i, i // 5, i % 5, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, doc_id long, pos long, v array<double>")
    built = index.build(v, v.where("vec_id < 4").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv")), 2)
    assert not {"v", "cv"} & set(built.postings.columns)
    built.save(str(tmp_path / "a"))
    assert index.Index.load(spark, str(tmp_path / "a")).postings.count() == 40
    index.Index(built.postings.where("embedding_pos <> 3"), built.centroids, built.cutoffs, built.weights).save(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="not a whole index"):
        index.Index.load(spark, str(tmp_path / "b"))


def test_fact_roots_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1, 5), (1, 0, 2, 6)], "query_id int, q_token_id tinyint, centroid_id int, num_token_token_sims int")
    sinks.save_facts(rows.limit(1), str(tmp_path / "b"), "m1")
    sinks.save_facts(rows, str(tmp_path / "b"), "m1")
    assert readers.facts(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "m1").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.facts(spark, str(tmp_path / "a"), "m1")
    sinks.erase(spark, str(tmp_path / "b" / "m1"))
    assert not (tmp_path / "b" / "m1").exists() and "revision" in sinks.provenance()


def test_matrix_and_flags(spark):
    df = spark.createDataFrame([(float(i), float(i * i), None if i == 3 else float(-i)) for i in range(12)], "a double, b double, c double")
    got = {(r.x, r.y): (r.r, r.n, r.p) for m in ("spearman", "kendall") for r in statistics.correlation_matrix(df, ["a", "b", "c"], m).collect()}
    assert all(abs(abs(r) - 1) < 1e-9 and p < 0.01 for r, _, p in got.values()) and got["a", "c"][1] == 11
    assert [r.tokens_per_doc for r in clusters.tokens_per_doc(spark.createDataFrame([(6, 3), (0, 0)], "n_tokens long, n_docs long")).collect()] == [2.0, 0.0]


def test_text(spark):
    one = spark.createDataFrame([("A, b  ! C",)], "t string")
    words = text.tokens(F.col("t"), 3)
    assert one.select(words.alias("w"), text.masked(words).alias("m")).first() == (["a,", "b", "!"], ["a,", "b"])
    assert one.select(text.unescaped(text.escaped(F.lit("a\tb\nc")))).first()[0] == "a\tb\nc"
    ids = spark.createDataFrame([(10,), (500_000,), (7,)], "k long")
    assert [r.pid for r in text.numbered(ids, "k").orderBy("k").collect()] == [0, 1, 2]


def test_blocked_products(spark, monkeypatch):
    a, b = spark.range(5).toDF("x"), spark.range(7).toDF("y")
    monkeypatch.setattr(index, "BROADCAST_BYTES", 64)
    assert index.products(a, b, 7, 4).count() == 35
