"""Every query of the engine by name: the Spark plan, its columns, and where SQL can say it the DuckDB twin."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.functions.vectors import norm
from polyseek.operators import clusters, encode, evaluate, facts, index, pairs, search, statistics, text
from polyseek.plans import config
from polyseek.plans.fixture import CELLS, CONFIG, Fixture
from polyseek.plans.twins import twin

_queries: dict[str, tuple[Callable[[Fixture], DataFrame], str, str | None]] = {}


def query(name: str, spec: str, sql: str | None = None) -> Callable:
    """Register f(fixture) under name. spec: columns with their kinds (i integer, f number to 6 digits, s text, b bool)."""

    def keep(f: Callable[[Fixture], DataFrame]) -> Callable:
        _queries[name] = (f, spec, sql)
        return f

    return keep


def shaped(df: DataFrame, spec: str) -> DataFrame:
    kinds = {"i": lambda c: c.cast("bigint"), "f": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
    return df.select(*[kinds[k](F.col(c)).alias(c) for c, k in (x.split(":") for x in spec.split())])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f, spec=spec: shaped(f(Fixture(spark, sf_dir)), spec)) for n, (f, spec, _) in _queries.items()}


def prepared(spark: SparkSession, sf_dir: str) -> Fixture:
    """A fixture whose stored parts (index, winners, facts) are written already: what a measured run has before its queries."""
    t = Fixture(spark, sf_dir)
    for part in ("index", "clustered", "cells", "won", "m4", "m5"):
        getattr(t, part)
    return t


def answer(name: str, t: Fixture) -> DataFrame:
    """The query called name over a fixture, which keeps what it has stored for the next."""
    f, spec, _ = _queries[name]
    return shaped(f(t), spec)


def oracle_sql() -> dict[str, str]:
    return {n: twin(sql, spec) for n, (_, spec, sql) in _queries.items() if sql}


TOK = "query_id:i q_token_id:i "

# Sources and text.
query("collection_load", "pid:i text:s", "SELECT doc_id AS pid, CASE WHEN length(source) > 0 THEN source || ' | ' || text ELSE text END AS text FROM documents")(
    lambda t: t.table("documents").select(F.col("doc_id").alias("pid"), text.passage(F.col("source"), F.col("text")).alias("text"))
)
query("collection_escape_roundtrip", "doc_id:i same:b escaped_chars:i", r"SELECT doc_id, true AS same, length(replace(replace(replace(text, chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS escaped_chars FROM documents")(
    lambda t: t.table("documents").withColumn("e", text.escaped(F.col("text"))).select("doc_id", (text.unescaped(F.col("e")) == F.col("text")).alias("same"), F.length("e").alias("escaped_chars"))
)
query("page_escape", "page_id:i escaped_chars:i", r"SELECT page_id, length(replace(replace(replace(html, chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS escaped_chars FROM pages")(
    lambda t: t.table("pages").select("page_id", F.length(text.escaped(F.col("html"))).alias("escaped_chars"))
)
query("query_tokens_truncate", "conv_id:i turn:i n_tokens:i first_token:s", r"SELECT conv_id, turn, len(w) AS n_tokens, w[1] AS first_token FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:32] AS w FROM conversations WHERE role = 'user')")(
    lambda t: t.table("conversations").where("role = 'user'").withColumn("w", text.tokens(F.col("text"), text.QUERY_TOKENS)).select("conv_id", "turn", F.size("w").alias("n_tokens"), F.get("w", F.lit(0)).alias("first_token"))
)
query("doc_lengths", "doc_id:i doclen:i", "SELECT doc_id, len(ws[1:512]) AS doclen FROM words")(
    lambda t: t.table("documents").select("doc_id", F.size(text.tokens(F.col("text"), text.DOC_TOKENS)).alias("doclen"))
)
query("punctuation_mask", "doc_id:i kept:i", "SELECT doc_id, len(list_filter(ws[1:512], lambda w: NOT (length(w) = 1 AND contains('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', w)))) AS kept FROM words")(
    lambda t: t.table("documents").select("doc_id", F.size(text.masked(text.tokens(F.col("text"), text.DOC_TOKENS))).alias("kept"))
)
query("token_positions", "doc_id:i pos:i token:s", "SELECT doc_id, generate_subscripts(ws[1:512], 1) - 1 AS pos, unnest(ws[1:512]) AS token FROM words")(
    lambda t: text.positions(t.table("documents"), "doc_id", text.tokens(F.col("text"), text.DOC_TOKENS))
)
query("chunk_offsets", "chunk:i passage_offset:i num_passages:i num_embeddings:i embedding_offset:i", "SELECT *, coalesce(sum(num_embeddings) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS embedding_offset FROM (SELECT p // 250 AS chunk, min(p) AS passage_offset, count(*) AS num_passages, sum(n_chars) AS num_embeddings FROM (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) GROUP BY 1)")(
    lambda t: text.chunks(t.table("documents"), "doc_id", 250, "n_chars")
)
query("dense_ids", "doc_id:i pid:i", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pid FROM documents")(lambda t: text.numbered(t.table("documents").select("doc_id"), "doc_id"))
query("batches", "doc_id:i batch:i offset:i", "SELECT doc_id, p // 64 AS batch, 64 * (p // 64) AS \"offset\" FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)")(
    lambda t: text.batches(t.table("documents").select("doc_id"), "doc_id", 64)
)
query("segment_offsets", "centroid_id:i start:i end:i", "SELECT centroid_id, start, start + size AS \"end\" FROM cells")(lambda t: text.offsets(t.cells, "centroid_id", "size"))
query("id_map_join", "query_id:i doc_id:s rank:i", "SELECT query_id, 'D' || doc_id AS doc_id, rank FROM top")(
    lambda t: search.translated(t.top, t.tokens.select("doc_id", F.concat(F.lit("D"), "doc_id").alias("external_id")).distinct())
)
query("qrels_semi_filter", TOK + "doc_id:i oracle_score:f", "SELECT query_id, q_token_id, doc_id, oracle_score FROM m4 SEMI JOIN qrels USING (query_id, doc_id)")(
    lambda t: t.m4.join(t.qrels, ["query_id", "doc_id"], "left_semi")
)
query("duplicate_qid_check", "conv_id:i n:i", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")(lambda t: text.duplicates(t.table("conversations"), "conv_id"))
query("group_by_first", "conv_id:i n_items:i first_role:s", "SELECT conv_id, count(*) AS n_items, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1")(
    lambda t: text.grouped_by_first(t.table("conversations"), "conv_id", "turn", "role").select("conv_id", F.size("items").alias("n_items"), F.col("items")[0]["role"].alias("first_role"))
)
query("event_json", "event_id:i n_props:i", "SELECT event_id, len(json_keys(props)) AS n_props FROM events")(
    lambda t: t.table("events").select("event_id", F.size(F.json_object_keys("props")).alias("n_props"))
)
query("set_operations", "doc_id:i side:s", "SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'documents' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")(
    lambda t: (lambda d, g: d.intersect(g).withColumn("side", F.lit("both")).unionByName(d.subtract(g).withColumn("side", F.lit("documents"))))(t.table("documents").select("doc_id"), t.table("labels").select("doc_id"))
)
_GRID = "(SELECT nprobe, query_id, count(DISTINCT doc_id) AS n FROM ranked JOIN (VALUES (1), (2), (4)) g(nprobe) ON rank <= nprobe JOIN post USING (centroid_id) GROUP BY ALL)"
query("experiment_grid", "nprobe:i k:i n_results:i n_queries:i", f"SELECT nprobe, k, sum(least(k, n)) AS n_results, count(*) AS n_queries FROM {_GRID}, (VALUES (5), (10)) c(k) GROUP BY ALL")(
    lambda t: _grid_run(t, config.grid(nprobe=[1, 2, 4], k=[5, 10]))
)


def _grid_run(t: Fixture, settings: list[dict]) -> DataFrame:
    """Every setting of a grid, searched: how many results it gives for how many queries."""
    out = None
    for given in settings:
        found = search.search(t.qtok, t.clustered, CONFIG.merged(config.SearchConfig.of(**given)))
        one = found.agg(*[F.lit(v).alias(k) for k, v in given.items()], F.count("*").alias("n_results"), F.countDistinct("query_id").alias("n_queries"))
        out = one if out is None else out.unionByName(one)
    return out

# Index.
query("assign_centroid", "vec_id:i centroid_id:i", "SELECT vec_id, centroid_id FROM asg")(lambda t: t.assigned)
_LLOYD = "(SELECT centroid_id, list(x ORDER BY d) AS m FROM (SELECT centroid_id, d, avg(x) AS x FROM (SELECT centroid_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {0}) GROUP BY ALL) GROUP BY 1)"
_UNIT = "list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))"
_NEXT = "(SELECT c.centroid_id, coalesce(" + _UNIT + ", c.cv) AS cv FROM {1} c LEFT JOIN " + _LLOYD + " s USING (centroid_id))"
_ASSIGN = "(SELECT * FROM (SELECT t.vec_id, t.v, c.centroid_id, row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_dot_product(t.v, c.cv), 9) DESC, c.centroid_id) AS rn FROM tok t CROSS JOIN {0} c) WHERE rn = 1)"
_ONE = _NEXT.format("asg", "cen")
_TWO = _NEXT.format(_ASSIGN.format(_ONE), _ONE)
query("kmeans_lloyd_2iter", "centroid_id:i dim:i value:f", f"SELECT centroid_id, generate_subscripts(cv, 1) - 1 AS dim, unnest(cv) AS value FROM {_TWO}")(
    lambda t: index.lloyd(t.tokens, t.seeds, 2).select("centroid_id", F.posexplode("cv").alias("dim", "value"))
)
query("codec_quantiles", "i:i cutoff:f weight:f", "SELECT i, cutoffs[i] AS cutoff, weights[i] AS weight FROM codec, range(1, 17) r(i)")(
    lambda t: index.codec_frame(index.residuals(t.assigned), 4).select(F.posexplode("weights").alias("p", "weight"), "cutoffs").select((F.col("p") + 1).alias("i"), F.get("cutoffs", F.col("p")).alias("cutoff"), "weight")
)
query("average_residual", "avg_residual:f", "SELECT avg_residual FROM codec")(lambda t: index.codec_frame(index.residuals(t.assigned), 4))
query("quantise_codes", "vec_id:i dim:i code:i", "SELECT vec_id, generate_subscripts(codes, 1) - 1 AS dim, unnest(codes) AS code FROM post")(lambda t: t.index.postings.select("vec_id", F.posexplode("codes").alias("dim", "code")))
query("pack_roundtrip", "vec_id:i byte:i value:i same:b", "SELECT vec_id, unnest(range(32)) AS byte, unnest(list_transform(range(32), lambda b: 16 * codes[2 * b + 1] + codes[2 * b + 2])) AS value, true AS same FROM post")(
    lambda t: t.index.postings.withColumn("p", index.packed(F.col("codes"), 4)).select("vec_id", (index.unpacked(F.col("p"), 4) == F.col("codes")).alias("same"), F.posexplode("p").alias("byte", "value"))
)
query("postings_order", "embedding_pos:i centroid_id:i doc_id:i vec_id:i", "SELECT embedding_pos, centroid_id, doc_id, vec_id FROM post")(lambda t: t.index.postings)
query("cluster_sizes_offsets", "centroid_id:i size:i start:i", "SELECT centroid_id, size, start FROM cells")(lambda t: t.cells)
query("ivf_distinct", "centroid_id:i doc_id:i", "SELECT DISTINCT centroid_id, doc_id FROM post")(lambda t: index.inverted_lists(t.index.postings))
query("reverse_index", "doc_id:i n:i first_pos:i last_pos:i", "SELECT doc_id, count(*) AS n, min(embedding_pos) AS first_pos, max(embedding_pos) AS last_pos FROM post GROUP BY 1")(
    lambda t: index.reverse_index(t.index.postings).select("doc_id", F.size("positions").alias("n"), F.col("positions")[0].alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))
)
query("embedding_to_centroid", "embedding_pos:i centroid_id:i", "SELECT embedding_pos, centroid_id FROM post")(lambda t: index.position_to_centroid(t.index.postings.select("embedding_pos"), t.cells, 64))
query("reconstruct_error", "vec_id:i cosine:f", "SELECT vec_id, list_dot_product(v, m) / sqrt(list_dot_product(m, m)) AS cosine FROM (SELECT vec_id, list_transform(list_zip(cv, w), lambda x: x[1] + x[2]) AS m FROM postw) JOIN (SELECT vec_id, v FROM tok) USING (vec_id)")(
    lambda t: t.index.postings.select("vec_id", "centroid_id", "codes").join(t.tokens.select("vec_id", "v"), "vec_id").join(t.cells.select("centroid_id", "cv"), "centroid_id").select(
        "vec_id", search.dot(F.col("v"), index.reconstructed(F.col("cv"), F.col("codes"), t.index.weights)).alias("cosine")
    )
)
query("index_integrity", "n_embeddings:i n_positions:i last_pos:i sum_sizes:i", "SELECT count(*) AS n_embeddings, count(DISTINCT embedding_pos) AS n_positions, max(embedding_pos) AS last_pos, (SELECT sum(size) FROM cells) AS sum_sizes FROM post")(lambda t: index.integrity(t.index))
query("index_plan", "passages:i sample:i partitions:i", "SELECT p AS passages, least(1 + CAST(floor(16 * sqrt(120 * p)) AS BIGINT), p) AS sample, CAST(pow(2, floor(log2(16 * sqrt(n)))) AS BIGINT) AS partitions FROM (SELECT count(DISTINCT doc_id) AS p, count(*) AS n FROM tok)")(
    lambda t: t.spark.createDataFrame([(lambda r: (r[0], config.sample_size(r[0]), config.partitions(r[1])))(t.tokens.agg(F.countDistinct("doc_id"), F.count("*")).first())], "passages long, sample long, partitions long")
)

# Routing and retrieval.
query("centroid_scores", TOK + "centroid_id:i score:f", "SELECT query_id, q_token_id, centroid_id, score FROM csc")(lambda t: t.scores)
query("topn_probe", TOK + "centroid_id:i rank:i score:f", "SELECT query_id, q_token_id, centroid_id, rank, score FROM routed")(lambda t: t.routed)
query("missing_similarity", TOK + "mse:f", "SELECT * FROM missing")(lambda t: t.missing)
query("probe_bound", TOK + "mse:f", "SELECT query_id, q_token_id, coalesce(arg_min(score, rank) FILTER (WHERE cum >= 200), arg_max(score, rank)) AS mse FROM ranked WHERE rank <= 3 GROUP BY ALL")(lambda t: search.missing_scores(t.scores, 200, 3))
_SIZES = "(SELECT (SELECT count(*) FROM cen) * f AS cells, (SELECT count(*) FROM tok) * g AS embeddings, k FROM (VALUES (1), (8192)) a(f), (VALUES (1), (1000), (1000000)) b(g), (VALUES (10), (100), (101)) c(k))"
query("t_prime_policy", "cells:i embeddings:i k:i t_prime:i", f"SELECT cells, embeddings, k, CASE WHEN cells <= 65536 THEN CAST(floor(sqrt(8 * embeddings) / 1000) AS BIGINT) * 1000 WHEN k > 100 THEN 100000 ELSE 50000 END AS t_prime FROM {_SIZES}")(
    lambda t: _t_primes(t)
)


def _t_primes(t: Fixture) -> DataFrame:
    """The default for the index's own sizes, and as if it were larger by some factors."""
    cells, embeddings = t.index.centroids.count(), t.index.postings.count()
    rows = [(cells * f, embeddings * g, k, config.t_prime(cells * f, embeddings * g, k)) for f in (1, 8192) for g in (1, 1000, 1_000_000) for k in (10, 100, 101)]
    return t.spark.createDataFrame(rows, "cells long, embeddings long, k long, t_prime long")


_EXACT = "(SELECT query_id, q_token_id, doc_id, max(list_dot_product(qv, v)) AS s FROM qtok CROSS JOIN tok GROUP BY ALL)"
query("exact_maxsim", "query_id:i doc_id:i score:f", f"SELECT query_id, doc_id, sum(s) AS score FROM {_EXACT} GROUP BY ALL")(lambda t: search.exact_maxsim(t.qtok, t.tokens))
query("relu_maxsim", "query_id:i doc_id:i score:f", f"SELECT query_id, doc_id, sum(greatest(s, 0)) AS score FROM {_EXACT} GROUP BY ALL")(lambda t: search.exact_maxsim(t.qtok, t.tokens, "relu"))
query("length_normalised_maxsim", "query_id:i doc_id:i score:f", f"SELECT query_id, doc_id, avg(s) AS score FROM {_EXACT} GROUP BY ALL")(lambda t: search.exact_maxsim(t.qtok, t.tokens, "mean"))
query("l2_maxsim", "query_id:i doc_id:i score:f", "SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, q_token_id, doc_id, max(2 * list_dot_product(qv, v) - list_dot_product(qv, qv) - list_dot_product(v, v)) AS s FROM qtok CROSS JOIN tok GROUP BY ALL) GROUP BY ALL")(lambda t: search.exact_maxsim(t.qtok, t.tokens, "l2"))
query("two_part_score", "query_id:i doc_id:i score:f", f"SELECT query_id, doc_id, coalesce(sum(s) FILTER (WHERE q_token_id < 2 AND r <= 1), 0) + coalesce(sum(s) FILTER (WHERE q_token_id >= 2 AND r <= 1), 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, q_token_id < 2 ORDER BY s DESC) AS r FROM {_EXACT}) GROUP BY ALL")(
    lambda t: search.two_part_maxsim(t.qtok, t.tokens, 2, (1, 1))
)
query("search_topk", "query_id:i doc_id:i rank:i score:f", "SELECT query_id, doc_id, rank, score FROM top")(lambda t: search.search(t.qtok, t.clustered, CONFIG))
query("search_quantised", "query_id:i doc_id:i score:f influential:i", "SELECT query_id, doc_id, score, influential FROM docs")(lambda t: t.docs)
_CONLY = "(SELECT query_id, doc_id, sum(coalesce(s, mse)) AS score FROM (SELECT DISTINCT query_id, doc_id FROM won) JOIN missing USING (query_id) LEFT JOIN (SELECT query_id, q_token_id, doc_id, max(cs) AS s FROM tsc GROUP BY ALL) USING (query_id, q_token_id, doc_id) GROUP BY ALL)"
query("search_centroid_only", "query_id:i doc_id:i rank:i score:f", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {_CONLY} QUALIFY rank <= 10")(
    lambda t: search.search(t.qtok, t.clustered, CONFIG.merged(config.SearchConfig.of(centroid_only=True)))
)
query("search_with_pid_filter", "query_id:i doc_id:i rank:i score:f", "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM docs SEMI JOIN (SELECT DISTINCT doc_id FROM tok WHERE label < 2) USING (doc_id) QUALIFY rank <= 10")(
    lambda t: search.search(t.qtok, t.clustered, CONFIG, t.tokens.where("label < 2").select("doc_id"))
)
query("token_winners", TOK + "doc_id:i embedding_pos:i score:f", "SELECT * FROM won")(lambda t: t.won)
query("influential_counts", "query_id:i influential:i documents:i", "SELECT query_id, influential, count(*) AS documents FROM docs GROUP BY ALL")(lambda t: t.docs.groupBy("query_id", "influential").agg(F.count("*").alias("documents")))
query("unique_docs", "query_id:i unique_docs:i", "SELECT query_id, count(DISTINCT doc_id) AS unique_docs FROM won GROUP BY 1")(lambda t: t.docs.groupBy("query_id").agg(F.count("*").alias("unique_docs")))
query("search_stats", "query_id:i query_length:i n_clusters_selected:i total_token_scores:i unique_docs:i", "SELECT query_id, (SELECT count(*) FROM qtok q WHERE q.query_id = won.query_id) AS query_length, (SELECT count(DISTINCT centroid_id) FROM routed r WHERE r.query_id = won.query_id) AS n_clusters_selected, count(*) AS total_token_scores, count(DISTINCT doc_id) AS unique_docs FROM won GROUP BY 1")(
    lambda t: search.search_statistics(t.qtok, t.routed, t.docs)
)

# The staged scorer.
_S0 = "(SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, centroid_id FROM ranked WHERE rank <= 2) JOIN post USING (centroid_id))"
_F1 = f"(SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, sum(coalesce(s, -9999)) AS score FROM {_S0} JOIN (SELECT DISTINCT query_id, q_token_id FROM qtok) USING (query_id) LEFT JOIN (SELECT c.query_id, c.q_token_id, p.doc_id, max(c.score) AS s FROM csc c JOIN (SELECT query_id, centroid_id FROM csc GROUP BY ALL HAVING max(score) >= 0.2) USING (query_id, centroid_id) JOIN post p ON p.centroid_id = c.centroid_id GROUP BY ALL) x USING (query_id, q_token_id, doc_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) <= 40)"
_F2 = f"(SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT f.query_id, f.doc_id, c.q_token_id, max(c.score) AS s FROM {_F1} f JOIN post p USING (doc_id) JOIN csc c ON c.query_id = f.query_id AND c.centroid_id = p.centroid_id GROUP BY ALL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) <= 10)"
query("stage_candidates", "query_id:i doc_id:i", f"SELECT * FROM {_S0}")(lambda t: search.stage_candidates(t.qtok, t.index, 2))
query("stage_filter1", "query_id:i doc_id:i score:f", f"SELECT * FROM {_F1}")(lambda t: search.first_filter(t.qtok, t.index, 2, 40, 0.2))
query("stage_filter2", "query_id:i doc_id:i score:f", f"SELECT * FROM {_F2}")(
    lambda t: search.stage_filter(search.first_filter(t.qtok, t.index, 2, 40, 0.2).select("query_id", "doc_id"), t.qtok, t.index, 10)
)
query("stage_final", "query_id:i doc_id:i rank:i score:f", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(greatest(s, 0)) AS score FROM (SELECT f.query_id, f.doc_id, q_token_id, max(list_dot_product(qv, m) / sqrt(list_dot_product(m, m))) AS s FROM {_F2} f JOIN (SELECT doc_id, list_transform(list_zip(cv, w), lambda x: x[1] + x[2]) AS m FROM postw) USING (doc_id) JOIN qtok USING (query_id) GROUP BY ALL) GROUP BY ALL) QUALIFY rank <= 5")(
    lambda t: search.staged_search(t.qtok, t.index, 5, (2, 0.2, 40))
)

# Oracle, facts, derived.
query("oracle_winners", TOK + "doc_id:i oracle_embedding_pos:i oracle_score:f oracle_centroid_id:i", "SELECT * FROM m4")(lambda t: t.m4)
query("oracle_smart_skip", TOK + "doc_id:i observed:f other:f skipped:b", "SELECT query_id, q_token_id, doc_id, any_value(w.score) AS observed, max(o.score) FILTER (WHERE o.embedding_pos <> w.embedding_pos) AS other, coalesce(any_value(w.score) >= max(o.score) FILTER (WHERE o.embedding_pos <> w.embedding_pos) - 0.01, true) AS skipped FROM orc o JOIN won w USING (query_id, q_token_id, doc_id) GROUP BY ALL")(
    lambda t: facts.smart_skip_of(t.measured("observed_score", "other"))
)
query("oracle_vs_observed", TOK + "doc_id:i gap:f", "SELECT query_id, q_token_id, doc_id, oracle_score - won.score AS gap FROM m4 JOIN won USING (query_id, q_token_id, doc_id)")(
    lambda t: t.measured("oracle_score", "observed_score").where("observed_score is not null").withColumn("gap", F.col("oracle_score") - F.col("observed_score"))
)
query("m1", TOK + "centroid_id:i num_token_token_sims:i", "SELECT * FROM m1")(lambda t: t.m1)
query("r0", TOK + "centroid_id:i rank:i centroid_score:f", "SELECT * FROM r0")(lambda t: t.r0)
query("m3", TOK + "doc_id:i winner_embedding_pos:i winner_score:f", "SELECT * FROM m3")(lambda t: t.m3)
query("m4", TOK + "doc_id:i oracle_embedding_pos:i oracle_score:f", "SELECT * FROM m4")(lambda t: t.m4)
query("m2", "query_id:i m1_total_sims:i m3_influential_pairs:i m2_redundant_sims:i redundancy_rate:f", "SELECT * FROM m2")(lambda t: facts.m2(t.m1, t.m3))
_M5 = TOK + "doc_id:i oracle_embedding_pos:i oracle_score:f oracle_centroid_id:i is_miss:b observed_embedding_pos:i observed_score:f score_delta:f"
query("m5", _M5, "SELECT * FROM m5")(lambda t: t.m5)
query("m5_topk_only", _M5, "SELECT * FROM m5 WHERE observed_score IS NOT NULL")(lambda t: facts.m5(facts.m4(facts.oracle_rows(t.qtok, t.top, t.index)), t.r0, t.m3, top_k_only=True))
_M6 = "oracle_centroid_id:i miss_count:i oracle_win_count:i miss_rate:f"
query("m6_global", _M6, "SELECT * FROM m6")(lambda t: t.m6)
query("m6_per_query", "query_id:i " + _M6, "SELECT query_id, oracle_centroid_id, count(*) FILTER (WHERE is_miss) AS miss_count, count(*) AS oracle_win_count, count(*) FILTER (WHERE is_miss) / count(*) AS miss_rate FROM m5 GROUP BY ALL")(lambda t: facts.m6(t.misses("query_id", "oracle_centroid_id"), ("query_id",)))
query("m6_grouping_sets", "query_id:i " + _M6, "SELECT query_id, oracle_centroid_id, count(*) FILTER (WHERE is_miss) AS miss_count, count(*) AS oracle_win_count, count(*) FILTER (WHERE is_miss) / count(*) AS miss_rate FROM m5 GROUP BY GROUPING SETS ((oracle_centroid_id), (query_id, oracle_centroid_id))")(lambda t: facts.m6_both(t.misses("query_id", "oracle_centroid_id")))
query("run_diagnostics", "fact:s n_rows:i n_queries:i", " UNION ALL ".join(f"SELECT '{f}' AS fact, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM {f}" for f in ("m1", "r0", "m3", "m4")))(
    lambda t: t.m1.select(F.lit("m1").alias("fact"), "query_id").union(t.r0.select(F.lit("r0"), "query_id")).union(t.m3.select(F.lit("m3"), "query_id")).union(t.m4.select(F.lit("m4"), "query_id")).groupBy("fact").agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"))
)

# Golden documents.
query("m4r", TOK + "doc_id:i oracle_embedding_pos:i oracle_score:f oracle_centroid_id:i num_doc_embeddings:i num_doc_centroids:i num_accessible_centroids:i oracle_is_accessible:b any_embedding_accessible:b", "SELECT * FROM m4r")(lambda t: t.m4r)
query("routing_status", "query_id:i doc_id:i oracle_hits:i num_tokens:i any_embedding_accessible:b num_doc_embeddings:i num_doc_centroids:i num_accessible_centroids:i routing_status:s oracle_hit_rate:f centroid_coverage:f", "SELECT * FROM status")(lambda t: t.status)
query("m6r", "query_id:i doc_id:i missed_centroid_id:i num_doc_centroids:i num_missed:i", "SELECT query_id, doc_id, centroid_id AS missed_centroid_id, num_doc_centroids, count(*) OVER (PARTITION BY query_id, doc_id) AS num_missed FROM (SELECT DISTINCT query_id, doc_id, centroid_id FROM qrels JOIN post USING (doc_id)) JOIN dstat USING (doc_id) ANTI JOIN (SELECT DISTINCT query_id, centroid_id FROM r0) USING (query_id, centroid_id)")(
    lambda t: facts.m6r(t.qrels, t.index.postings, t.r0)
)
query("recall_by_status", "routing_status:s pairs:i found:i recall:f", "SELECT routing_status, count(*) AS pairs, count(rank) AS found, count(rank) / count(*) AS recall FROM status LEFT JOIN top USING (query_id, doc_id) GROUP BY 1")(lambda t: facts.recall_by(t.status, t.top, "routing_status"))
query("hit_rate_bins", "hit_bin:f pairs:i found:i recall:f", "SELECT CASE WHEN oracle_hit_rate <= 0.5 THEN 0.5 WHEN oracle_hit_rate <= 0.7 THEN 0.7 WHEN oracle_hit_rate <= 0.8 THEN 0.8 WHEN oracle_hit_rate <= 0.9 THEN 0.9 WHEN oracle_hit_rate <= 0.95 THEN 0.95 ELSE 1 END AS hit_bin, count(*) AS pairs, count(rank) AS found, count(rank) / count(*) AS recall FROM status LEFT JOIN top USING (query_id, doc_id) GROUP BY 1")(
    lambda t: facts.recall_by(facts.hit_rate_bin(t.status), t.top, "hit_bin")
)
query("rescue_mechanism", "mechanism:s pairs:i", "SELECT CASE WHEN oracle_hits > 0 THEN 'lucky_oracle' ELSE 'non_oracle_rescue' END AS mechanism, count(*) AS pairs FROM status SEMI JOIN top USING (query_id, doc_id) WHERE routing_status = 'partial' GROUP BY 1")(lambda t: facts.rescue(t.status, t.top))
query("fallback_strength", TOK + "doc_id:i num_fallback:i relative_gap:f strength:s", "SELECT query_id, q_token_id, doc_id, num_fallback, g AS relative_gap, CASE WHEN g IS NULL THEN 'none' WHEN g < 0.05 THEN 'strong' WHEN g < 0.2 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT query_id, q_token_id, doc_id, coalesce(n, 0) AS num_fallback, CASE WHEN oracle_score > 0 THEN (oracle_score - best) / oracle_score WHEN best IS NOT NULL THEN 0 END AS g FROM m4r LEFT JOIN (SELECT query_id, q_token_id, doc_id, count(*) AS n, max(score) AS best FROM orc SEMI JOIN r0 USING (query_id, q_token_id, centroid_id) GROUP BY ALL) x USING (query_id, q_token_id, doc_id) WHERE NOT oracle_is_accessible)")(
    lambda t: t.fallback
)
query("centroid_spread", TOK + "doc_id:i strong:i strong_centroids:i capture_rate:f", "SELECT query_id, q_token_id, doc_id, count(*) AS strong, count(DISTINCT centroid_id) AS strong_centroids, count(rank) / count(*) AS capture_rate FROM (SELECT *, max(score) OVER w AS m, stddev_pop(score) OVER w AS d FROM orc WINDOW w AS (PARTITION BY query_id, q_token_id, doc_id)) LEFT JOIN r0 USING (query_id, q_token_id, centroid_id) WHERE score >= m - 1.5 * d GROUP BY ALL")(
    lambda t: t.measured("strong", "strong_centroids", "strong_probed").where("strong > 0").withColumn("capture_rate", F.col("strong_probed") / F.col("strong"))
)

# Cluster metrics.
query("a1_a2", "centroid_id:i n_tokens:i n_docs:i", "SELECT * FROM sized")(lambda t: clusters.size_docs(t.index.postings))
query("a3_shares", "centroid_id:i top_1_doc_share:f top_5_doc_share:f top_10_doc_share:f", "SELECT * FROM shares")(lambda t: clusters.doc_shares(t.index.postings))
query("gini_docs", "centroid_id:i gini_coefficient:f", "SELECT * FROM dgini")(lambda t: clusters.gini(clusters.doc_counts(t.index.postings), ["centroid_id"], "n", "gini_coefficient"))
query("a5_dispersion", "centroid_id:i dispersion:f", "SELECT * FROM disp")(lambda t: clusters.dispersion(t.index.postings, t.index.weights))
query("b5_isolation", "centroid_id:i isolation:f nearest_neighbor_sim:f mean_neighbor_sim:f", "SELECT * FROM isol")(lambda t: clusters.isolation(t.seeds))
query("sel_freq", "centroid_id:i sel_freq:i", "SELECT * FROM freq")(lambda t: t.freq)
query("anti_hub", "num_centroids:i num_anti_hubs:i anti_hub_rate:f", "SELECT count(*) AS num_centroids, count(*) FILTER (WHERE sel_freq = 0) AS num_anti_hubs, count(*) FILTER (WHERE sel_freq = 0) / count(*) AS anti_hub_rate FROM freq")(lambda t: clusters.anti_hubs(t.freq))
query("traffic_concentration", "traffic_gini:f top_1pct_share:f top_5pct_share:f top_10pct_share:f", "SELECT 2 * sum(i * sel_freq) / (count(*) * sum(sel_freq)) - (count(*) + 1) / count(*) AS traffic_gini, sum(sel_freq) FILTER (WHERE r <= greatest(1, c // 100)) / sum(sel_freq) AS top_1pct_share, sum(sel_freq) FILTER (WHERE r <= greatest(1, c * 5 // 100)) / sum(sel_freq) AS top_5pct_share, sum(sel_freq) FILTER (WHERE r <= greatest(1, c * 10 // 100)) / sum(sel_freq) AS top_10pct_share FROM (SELECT *, row_number() OVER (ORDER BY sel_freq) AS i, row_number() OVER (ORDER BY sel_freq DESC, centroid_id) AS r, count(*) OVER () AS c FROM freq)")(
    lambda t: clusters.traffic_concentration(t.freq)
)
_ACT = "query_id:i unique_centroids:i load_cv:f activation_entropy:f normalized_activation_entropy:f load_gini:f top_5_centroid_share:f"
query("activation_entropy", _ACT, "SELECT * FROM activ")(lambda t: clusters.query_activation(t.m1))
query("load_imbalance", "query_id:i centroid_id:i n:i", "SELECT * FROM load")(lambda t: clusters.query_load(t.m1))
query("yield", "centroid_id:i computed:i influential:i yield:f", "SELECT * FROM yld")(lambda t: t.yields)
query("hub_class", "centroid_id:i sel_freq:i yield:f traffic_share:f bad_hubness:f good_hubness:f hub_type:s", "SELECT * FROM hub")(lambda t: clusters.hubs(t.freq, t.yields))
_EV = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS {0} FROM (SELECT query_id, doc_id, sum({1}) AS s FROM {2} GROUP BY ALL)"
query("evidence_recall", "query_id:i recall_at_10:f recall_at_100:f recall_at_1000:f", "SELECT query_id, " + ", ".join(f"count(*) FILTER (WHERE o <= {k} AND a <= {k}) / least({k}, count(*)) AS recall_at_{k}" for k in (10, 100, 1000)) + f" FROM ({_EV.format('o', 'oracle_score', 'm4')}) LEFT JOIN ({_EV.format('a', 'winner_score', 'm3')}) USING (query_id, doc_id) GROUP BY 1")(
    lambda t: clusters.evidence_recall(t.m3, t.places)
)
query("evidence_dispersion", "mean:f median:f max:i single:f several:f", "SELECT avg(n) AS mean, median(n) AS median, max(n) AS max, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) AS single, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END) AS several FROM (SELECT query_id, doc_id, count(DISTINCT oracle_centroid_id) AS n FROM m4 GROUP BY ALL)")(lambda t: clusters.evidence_dispersion(pairs.oracle_documents(*t.met)))
query("routing_fidelity", "query_id:i hits:i misses:i fidelity:f", "SELECT query_id, count(*) FILTER (WHERE NOT is_miss) AS hits, count(*) FILTER (WHERE is_miss) AS misses, count(*) FILTER (WHERE NOT is_miss) / count(*) AS fidelity FROM m5 GROUP BY 1")(lambda t: clusters.routing_fidelity(t.misses("query_id")))

# Frames.
_OFF = "n_tokens:i n_docs:i top_1_doc_share:f top_5_doc_share:f top_10_doc_share:f gini_coefficient:f dispersion:f isolation:f nearest_neighbor_sim:f mean_neighbor_sim:f"
_FRAME = "centroid_id:i " + _OFF + " sel_freq:i yield:f traffic_share:f bad_hubness:f good_hubness:f hub_type:s miss_count:i oracle_win_count:i m6_miss_rate:f m1_sims:i redundancy:f log_n_tokens:f is_anti_hub:b traffic_quartile:i"
query("cluster_frame", _FRAME, "SELECT * FROM frame")(lambda t: t.frame)
query("unified_centroid_table", "centroid_id:i n_tokens:i sel_freq:i miss_count:i m1_sims:i hub_type:s", "SELECT centroid_id, n_tokens, sel_freq, miss_count, m1_sims, hub_type FROM frame0")(lambda t: t.frame)
query("query_frame", _ACT + " m1_total_sims:i m3_influential_pairs:i redundancy_rate:f misses:i oracle_wins:i miss_rate:f max_score_delta:f", "SELECT * FROM m2 LEFT JOIN activ USING (query_id) LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE is_miss) AS misses, count(*) AS oracle_wins, count(*) FILTER (WHERE is_miss) / count(*) AS miss_rate, max(score_delta) AS max_score_delta FROM m5 GROUP BY 1) USING (query_id)")(
    lambda t: clusters.query_frame(facts.m2(t.m1, t.m3), clusters.query_activation(t.m1), t.misses("query_id"))
)
query("miss_attribution", TOK + "doc_id:i oracle_centroid_id:i score_delta:f oracle_n_tokens:i oracle_dispersion:f", "SELECT query_id, q_token_id, doc_id, oracle_centroid_id, score_delta, n_tokens AS oracle_n_tokens, dispersion AS oracle_dispersion FROM m5 LEFT JOIN offline ON centroid_id = oracle_centroid_id WHERE is_miss")(
    lambda t: clusters.miss_attribution(pairs.measured(*t.ranked, ("oracle_centroid_id", "score_delta"), missed=True), t.offline)
)
query("severity_by_centroid", "oracle_centroid_id:i n:i mean_score_delta:f max_score_delta:f std_score_delta:f", "SELECT oracle_centroid_id, count(*) AS n, avg(score_delta) AS mean_score_delta, max(score_delta) AS max_score_delta, stddev_pop(score_delta) AS std_score_delta FROM m5 WHERE is_miss GROUP BY 1")(lambda t: clusters.severity(t.missed_cells))

# Evaluation.
_RANK = "(SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS r FROM docs)"
_REL = "(SELECT query_id, count(*) AS n FROM qrels GROUP BY 1)"
query("recall_at_k", "query_id:i recall_5:f recall_10:f recall_50:f recall_100:f", f"SELECT query_id, " + ", ".join(f"count(r) FILTER (WHERE r <= {k}) / any_value(n) AS recall_{k}" for k in (5, 10, 50, 100)) + f" FROM {_REL} JOIN qrels USING (query_id) LEFT JOIN {_RANK} USING (query_id, doc_id) GROUP BY 1")(
    lambda t: evaluate.recall_at(t.docs, t.qrels)
)
query("ndcg_at_k", "query_id:i ndcg_5:f ndcg_10:f ndcg_50:f ndcg_100:f", "SELECT query_id, " + ", ".join(f"coalesce(sum(relevance / log2(r + 1)) FILTER (WHERE r <= {k}), 0) / sum(relevance / log2(i + 1)) FILTER (WHERE i <= {k}) AS ndcg_{k}" for k in (5, 10, 50, 100)) + f" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM qrels) LEFT JOIN {_RANK} USING (query_id, doc_id) GROUP BY 1")(
    lambda t: evaluate.ndcg_at(t.docs, t.qrels)
)
query("map_at_k", "query_id:i map_5:f map_10:f map_50:f map_100:f", "SELECT query_id, " + ", ".join(f"coalesce(sum(h / r) FILTER (WHERE r <= {k}), 0) / any_value(n) AS map_{k}" for k in (5, 10, 50, 100)) + f" FROM {_REL} LEFT JOIN (SELECT query_id, r, row_number() OVER (PARTITION BY query_id ORDER BY r) AS h FROM {_RANK} SEMI JOIN qrels USING (query_id, doc_id)) USING (query_id) GROUP BY 1")(
    lambda t: evaluate.map_at(t.docs, t.qrels)
)
query("success_at_k", " ".join(f"success_{k}:f recall_{k}:f" for k in (5, 10, 100, 1000)), "SELECT " + ", ".join(f"avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0 END) AS success_{k}, avg(CASE WHEN hits > 0 THEN h{k} / n END) AS recall_{k}" for k in (5, 10, 100, 1000)) + " FROM (SELECT query_id, any_value(n) AS n, count(r) AS hits, " + ", ".join(f"count(r) FILTER (WHERE r <= {k}) AS h{k}" for k in (5, 10, 100, 1000)) + f" FROM {_REL} JOIN qrels USING (query_id) LEFT JOIN (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM docs) USING (query_id, doc_id) GROUP BY 1)")(
    lambda t: evaluate.success_at(t.docs, t.qrels)
)

# Statistics, on tables that have enough rows.
query("quartile_bins", "p_size:i n:i lo:f hi:f", "SELECT greatest(1, len(list_filter((SELECT list_distinct(quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1])) FROM part), lambda e: e < p_retailprice))) AS p_size, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1")(
    lambda t: clusters.quantile_bin(t.table("part").select(F.col("p_retailprice").cast("double").alias("x")), "x", [0, 0.25, 0.5, 0.75, 1], "p_size").groupBy("p_size").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
)
query("percentile_bins", "bin:i n:i", "SELECT greatest(1, len(list_filter((SELECT list_distinct(quantile_cont(l_quantity, [0, 0.1, 0.5, 0.9, 1])) FROM lineitem), lambda e: e < l_quantity))) AS bin, count(*) AS n FROM lineitem GROUP BY 1")(
    lambda t: clusters.quantile_bin(t.table("lineitem").select(F.col("l_quantity").cast("double").alias("x")), "x", [0, 0.1, 0.5, 0.9, 1], "bin").groupBy("bin").agg(F.count("*").alias("n"))
)
query("stratify", "event_type:s mean:f std:f median:f n:i", "SELECT event_type, avg(value) AS mean, stddev(value) AS std, median(value) AS median, count(value) AS n FROM events GROUP BY 1")(lambda t: statistics.stratify(t.table("events"), "event_type", "value"))
query("describe_extended", "n:i mean:f std:f min:f max:f p5:f p25:f p50:f p75:f p95:f skewness:f kurtosis:f iqr:f", "SELECT count(value) AS n, avg(value) AS mean, stddev(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, skewness(value) AS skewness, kurtosis(value) AS kurtosis, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events")(
    lambda t: statistics.describe_extended(t.table("events"), "value")
)
_LI = "(SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS z FROM lineitem)"


def _li(t: Fixture) -> DataFrame:
    return t.table("lineitem").select(*[F.col(c).cast("double").alias(n) for c, n in (("l_quantity", "x"), ("l_extendedprice", "y"), ("l_discount", "z"))])


_AVGRANK = "(SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM {0})"
query("pearson", "r:f n:i", f"SELECT corr(x, y) AS r, count(*) AS n FROM {_LI}")(lambda t: statistics.pearson(_li(t), "x", "y"))
query("spearman", "r:f n:i", f"SELECT corr(rx, ry) AS r, count(*) AS n FROM {_AVGRANK.format(_LI)}")(lambda t: statistics.spearman(_li(t), "x", "y"))
query("kendall_cells", "tau:f n:i", "SELECT sum(sign(b.x - a.x) * sign(b.y - a.y)) / sqrt(sum(CASE WHEN a.x <> b.x THEN 1.0 ELSE 0 END) * sum(CASE WHEN a.y <> b.y THEN 1.0 ELSE 0 END)) AS tau, (SELECT count(*) FROM offline) AS n FROM (SELECT centroid_id, CAST(n_tokens AS DOUBLE) AS x, dispersion AS y FROM offline) a JOIN (SELECT centroid_id, CAST(n_tokens AS DOUBLE) AS x, dispersion AS y FROM offline) b ON a.centroid_id < b.centroid_id")(
    lambda t: statistics.kendall(t.offline, "n_tokens", "dispersion")
)
_PAIRED = f"(SELECT a.x AS lo, b.x AS hi FROM (SELECT DISTINCT x FROM {_LI}) a JOIN (SELECT DISTINCT x FROM {_LI}) b ON a.x < b.x)"
# Of each two values of x the Mann-Whitney statistic of y: concordant less discordant pairs are 2 U - m n.
_MW = f"(SELECT lo, hi, sum(CASE WHEN x = hi THEN r ELSE 0 END) AS rs, count(*) FILTER (WHERE x = hi) AS n2, count(*) FILTER (WHERE x = lo) AS n1 FROM (SELECT lo, hi, x, rank() OVER (PARTITION BY lo, hi ORDER BY y) + (count(*) OVER (PARTITION BY lo, hi, y) - 1) / 2 AS r FROM {_PAIRED} JOIN {_LI} l ON l.x = lo OR l.x = hi) GROUP BY ALL)"
_TIES = "(SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM {0} GROUP BY {1}))"
query("kendall", "tau:f n:i", f"SELECT s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau, n FROM (SELECT (SELECT sum(2 * (rs - n2 * (n2 + 1) / 2) - n1 * n2) FROM {_MW}) AS s, (SELECT count(*) FROM {_LI}) AS n, {_TIES.format(_LI, 'x')} AS tx, {_TIES.format(_LI, 'y')} AS ty)")(
    lambda t: statistics.kendall(_li(t), "x", "y")
)
query("partial_corr", "r:f n:i", f"SELECT (corr(x, y) - corr(x, z) * corr(y, z)) / sqrt((1 - corr(x, z) ** 2) * (1 - corr(y, z) ** 2)) AS r, count(*) AS n FROM {_LI}")(lambda t: statistics.partial_correlation(_li(t), "x", "y", "z"))
_G = "(SELECT event_type AS g, avg(value) AS m, variance(value) AS v, count(value) AS n FROM events GROUP BY 1)"
query("effect_sizes", "group_1:s group_2:s cohens_d:f", f"SELECT a.g AS group_1, b.g AS group_2, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS cohens_d FROM {_G} a JOIN {_G} b ON a.g < b.g")(lambda t: statistics.effect_sizes(t.table("events"), "event_type", "value"))
query("cohens_d", "cohens_d:f", "SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS cohens_d FROM (SELECT quality AS g, avg(n_chars) AS m, variance(n_chars) AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) a JOIN (SELECT quality AS g, avg(n_chars) AS m, variance(n_chars) AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) b ON a.g < b.g")(
    lambda t: statistics.effect_sizes(t.table("documents").join(t.table("labels"), "doc_id"), "quality", "n_chars")
)
query("group_comparison", "quality:i mean:f baseline_mean:f rel_diff:f t:f df:f cohens_d:f mann_whitney_u:f", "SELECT a.g AS quality, a.m AS mean, b.m AS baseline_mean, (a.m - b.m) / b.m AS rel_diff, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS cohens_d, a.rs - a.n * (a.n + 1) / 2 AS mann_whitney_u FROM (SELECT quality AS g, avg(n_chars) AS m, variance(n_chars) AS v, count(*) AS n, sum(rx) AS rs FROM (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rx FROM documents JOIN labels USING (doc_id)) GROUP BY 1) a, (SELECT quality AS g, avg(n_chars) AS m, variance(n_chars) AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) b WHERE a.g = 1 AND b.g = 0")(
    lambda t: statistics.group_comparison(t.table("documents").join(t.table("labels"), "doc_id"), "quality", "n_chars", 0)
)
query("chi_square_stat", "chi2:f df:i", "SELECT sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e) AS chi2, 1 AS df FROM (SELECT count(o.doc_id) AS o, any_value(ra.n) * any_value(rb.n) / (SELECT count(*) FROM labels) AS e FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1) ra CROSS JOIN (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) rb LEFT JOIN labels o USING (quality, toxic) GROUP BY quality, toxic)")(
    lambda t: statistics.chi_square(t.table("labels"), "quality", "toxic")
)
query("ols_slope", "slope:f intercept:f r2:f n:i slope_se_hc3:f", f"SELECT any_value(b) AS slope, any_value(a) AS intercept, any_value(r2) AS r2, count(*) AS n, sqrt(sum(((x - m) * (y - a - b * x) / (1 - 1 / c - (x - m) ** 2 / s)) ** 2)) / any_value(s) AS slope_se_hc3 FROM {_LI}, (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, avg(x) AS m, regr_sxx(y, x) AS s, count(*) AS c FROM {_LI})")(
    lambda t: statistics.ols(_li(t), "x", "y")
)
query("ecdf", "value:f cdf:f", "SELECT l_quantity AS value, sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER () AS cdf FROM lineitem GROUP BY 1")(lambda t: statistics.ecdf(t.table("lineitem"), "l_quantity").withColumnRenamed("l_quantity", "value"))
query("pareto", "centroid_id:i sel_freq:i rank_share:f cum_share:f", "SELECT centroid_id, sel_freq, row_number() OVER w / count(*) OVER () AS rank_share, sum(sel_freq) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(sel_freq) OVER () AS cum_share FROM freq WINDOW w AS (ORDER BY sel_freq DESC, centroid_id)")(lambda t: statistics.pareto(t.freq, "centroid_id", "sel_freq"))
query("histogram", "bin:i n:i", "SELECT least(CAST(floor(o_totalprice / 25000) AS BIGINT), 19) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1")(lambda t: statistics.histogram(t.table("orders"), "o_totalprice", 0.0, 500000.0, 20))
query("crosstab", "lang:s q0:i q1:i", "SELECT lang, count(*) FILTER (WHERE quality = 0) AS q0, count(*) FILTER (WHERE quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")(
    lambda t: t.table("documents").join(t.table("labels"), "doc_id").groupBy("lang").pivot("quality", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "q0", "1": "q1"})
)


# What SQL does not express: rows only.
@query("encode_pandas_udf", "doc_id:i pos:i norm:f", "SELECT doc_id, pos, 1.0 AS norm FROM (SELECT doc_id, generate_subscripts(ws[1:512], 1) - 1 AS pos, unnest(ws[1:512]) AS t FROM words) WHERE NOT (length(t) = 1 AND contains('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', t))")
def _encode(t: Fixture) -> DataFrame:
    """Token vectors of documents by the encoder without a model: where they stand, and that they have length 1."""
    out = encode.encode(t.table("documents"), "doc_id", text.tokens(F.col("text"), text.DOC_TOKENS), length="norm")
    return out.select("doc_id", "pos", "norm")


@query("arrow_residual_scorer", TOK + "doc_id:i score:f", "SELECT query_id, q_token_id, doc_id, max(score) AS score FROM tsc GROUP BY ALL")
def _arrow_scorer(t: Fixture) -> DataFrame:
    """Token scores by numpy gathers and products in Arrow batches: the form for long vectors, where array functions interpret."""
    return t.measured("best_probed").where("best_probed is not null").withColumnRenamed("best_probed", "score")


@query("mllib_kmeans", "cells:i embeddings:i mllib_cost:f lloyd_cost:f")
def _mllib(t: Fixture) -> DataFrame:
    """The library's k-means beside the engine's: the sum over vectors of one minus the cosine with their cell's centroid, after
    as many rounds from starts of their own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = t.tokens.select("vec_id", "v", array_to_vector("v").alias("features"))
    model = KMeans(k=CELLS, maxIter=4, seed=123, distanceMeasure="cosine").fit(data)
    theirs = t.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, cv array<double>")  # a row for each cell
    cost = lambda rows: rows.agg(F.sum(1 - search.dot(F.col("v"), F.col("cv")) / (norm(F.col("v")) * norm(F.col("cv"))))).first()[0]
    mllib = cost(model.transform(data).join(F.broadcast(theirs), "prediction"))
    ours = cost(index.assign(t.tokens, index.lloyd(t.tokens, t.seeds, 4)))
    return model.transform(data).select(F.col("prediction"), vector_to_array("features")).agg(F.countDistinct("prediction").alias("cells"), F.count("*").alias("embeddings"), F.lit(mllib).alias("mllib_cost"), F.lit(ours).alias("lloyd_cost"))


_U = "(SELECT event_type, b, value, CAST('0x' || substr(md5(event_id || '_' || b), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM events, range(1, 201) r(b))"
_POISSON = " + ".join(f"CASE WHEN u >= {sum(math.exp(-1) / math.factorial(j) for j in range(i))!r} THEN 1 ELSE 0 END" for i in range(1, 9))


@query("bootstrap_ci", "event_type:s mean:f lo:f hi:f", f"SELECT event_type, avg(m) AS mean, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT event_type, b, sum(w * value) / sum(w) AS m FROM (SELECT *, {_POISSON} AS w FROM {_U}) GROUP BY ALL) GROUP BY 1")
def _bootstrap(t: Fixture) -> DataFrame:
    """A Poisson bootstrap in one pass: each row enters each of 200 resamples a Poisson(1) number of times, by a hash that is
    the same in every engine. Resamples are sums of groups; no row is drawn on the driver."""
    e = t.table("events").select("event_id", "event_type", "value")
    r = e.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(200))))
    return statistics.poisson_bootstrap(r, "event_type", "value", F.concat_ws("_", "event_id", "b"))


@query("hypothesis_reports", "hypothesis:s supported:b effect_size:f p_value:f n:i")
def _reports(t: Fixture) -> DataFrame:
    from polyseek.operators import hypotheses
    from polyseek.sources.scratch import stored

    return hypotheses.reports(stored(t.frame), stored(clusters.severity(t.missed_cells)), stored(t.fallback), stored(t.status), t.top)  # several reports read each


@query("incremental_search_append", "query_id:i doc_id:i rank:i score:f", "SELECT query_id, doc_id, rank, score FROM top")
def _incremental(t: Fixture) -> DataFrame:
    """The queries arrive as a stream of files; every micro-batch searches and appends its ranking."""
    from polyseek.sources.scratch import folder
    from polyseek.streaming.incremental import search_stream

    root = folder(t.spark)
    t.qtok.select("query_id", "q_token_id", "qv").repartition(2, "query_id").write.parquet(f"{root}/in")
    search_stream(t.spark, f"{root}/in", t.clustered, CONFIG, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


from polyseek.plans import forms, ingest, measures  # noqa: E402, F401  they register more queries
