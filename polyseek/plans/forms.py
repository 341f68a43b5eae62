"""Queries of the stored forms: postings by cell, byte tables, runs behind a manifest, ragged vectors, data of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.functions import user
from polyseek.operators import blocks, evaluate, facts, hypotheses, index, pairs, plots, ragged, search, statistics, text
from polyseek.plans import catalog
from polyseek.plans.catalog import TOK, query
from polyseek.plans.config import SearchConfig
from polyseek.plans.fixture import CONFIG, T_PRIME, Fixture
from polyseek.sources import readers, sinks
from polyseek.sources.runs import Measures, Run, typed
from polyseek.sources.scratch import folder, stored

# Packed codes and their scores.


@query("block_winners", TOK + "doc_id:i embedding_pos:i score:f", "SELECT * FROM won")
def _block_winners(t: Fixture) -> DataFrame:
    """Token winners from packed blocks of the probed cells, by byte tables of 4-bit codes."""
    routed = stored(search.routes(t.qtok, search.centroid_matrix(t.index.centroids), CONFIG.nprobe, T_PRIME))
    return search.block_winners(t.qtok, routed.select("query_id", "q_token_id", F.inline("probes")), t.clustered)


_CODEC2 = "(SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS cuts, quantile_cont(x, [0.125, 0.375, 0.625, 0.875]) AS ws FROM (SELECT unnest(r) AS x FROM res))"
_TSC2 = f"(SELECT r.query_id, r.q_token_id, p.doc_id, p.embedding_pos, r.rank, r.score + list_dot_product(qv, list_transform(s.r, lambda y: ws[len(list_filter(cuts, lambda c: c < y)) + 1])) AS score FROM routed r JOIN post p USING (centroid_id) JOIN res s USING (vec_id) JOIN qtok USING (query_id, q_token_id) CROSS JOIN {_CODEC2})"


@query("block_winners_two_bits", TOK + "doc_id:i embedding_pos:i score:f", f"SELECT query_id, q_token_id, doc_id, embedding_pos, score FROM {_TSC2} QUALIFY row_number() OVER (PARTITION BY query_id, q_token_id, doc_id ORDER BY round(score, 9) DESC, rank, embedding_pos) = 1")
def _two_bit_winners(t: Fixture) -> DataFrame:
    built = index.build(t.tokens, t.seeds, 2, heldout=F.lit(True))
    two = index.Index(stored(built.postings), stored(built.centroids), built.cutoffs, built.weights).clustered(folder(t.spark))
    routed = stored(search.routes(t.qtok, search.centroid_matrix(two.centroids), CONFIG.nprobe, T_PRIME))
    return search.block_winners(t.qtok, routed.select("query_id", "q_token_id", F.inline("probes")), two)


@query("packed_blocks_roundtrip", "embedding_pos:i centroid_id:i doc_id:i dim:i code:i", "SELECT embedding_pos, centroid_id, doc_id, generate_subscripts(codes, 1) - 1 AS dim, unnest(codes) AS code FROM post")
def _packed_roundtrip(t: Fixture) -> DataFrame:
    """A saved index, loaded: its rows by document, with codes from packed bytes."""
    root = folder(t.spark)
    t.index.save(root)
    return index.Index.load(t.spark, root).postings.select("embedding_pos", "centroid_id", "doc_id", F.posexplode("codes").alias("dim", "code"))


@query("oracle_of_loaded_index", TOK + "doc_id:i oracle_embedding_pos:i oracle_score:f", "SELECT * FROM m4")
def _loaded_oracle(t: Fixture) -> DataFrame:
    """Exhaustive scores of the touched documents, from the copy of the postings by document."""
    root = folder(t.spark)
    t.index.save(root)
    touched = t.index.postings.join(t.routed.select("centroid_id").distinct(), "centroid_id", "left_semi")
    return facts.oracle(t.qtok, t.routed, index.Index.load(t.spark, root), touched.select("doc_id"), columns=("oracle_embedding_pos", "oracle_score"))


@query("probed_cells_scan", "centroid_id:i n:i first:i last:i", "SELECT centroid_id, size AS n, start AS first, start + size - 1 AS last FROM cells SEMI JOIN (SELECT DISTINCT centroid_id FROM routed WHERE rank = 1) USING (centroid_id) WHERE size > 0")
def _probed(t: Fixture) -> DataFrame:
    """What a scan by cell reads for the best cell of each query token."""
    cells = [r.centroid_id for r in t.routed.where("rank = 1").select("centroid_id").distinct().collect()]  # of an index's cells
    rows = blocks.of_cells(t.clustered.blocks, cells, t.clustered.per_folder).where(F.col("centroid_id").isin(cells))
    n = (F.length("docs") / 8).cast("long")
    return rows.groupBy("centroid_id").agg(F.sum(n).alias("n"), F.min("first").alias("first"), F.max(F.col("first") + n - 1).alias("last"))


query("index_size", "part:s bytes:i", "SELECT 'codes' AS part, 32 * count(*) AS bytes FROM tok UNION ALL SELECT 'ids', 16 * count(*) FROM tok UNION ALL SELECT 'centroids', 256 * count(*) FROM cen UNION ALL SELECT 'sizes', 8 * count(*) FROM cen")(
    lambda t: sinks.index_size(t.index)
)

# Runs.
_M3 = "query_id:i q_token_id:i doc_id:i winner_embedding_pos:i winner_score:f"


@query("facts_compacted", _M3, "SELECT * FROM m3")
def _compacted(t: Fixture) -> DataFrame:
    """Winners written as twenty chunks, merged behind the manifest, the old files deleted."""
    run, rows = Run(t.spark, folder(t.spark)), t.m3
    for i in range(20):
        run.add({"m3": rows.where(F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(20)) == i)}, batch=str(i))
        run.add({"m3": rows}, batch=str(i))  # a batch that is run again adds nothing
    run.compact("m3")
    run.vacuum()
    return run.read("m3")


_COUNTS = " UNION ALL ".join(f"SELECT '{f}' AS fact, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, sum({c}) AS total FROM {f}" for f, c in (("m1", "num_token_token_sims"), ("r0", "rank"), ("m3", "winner_embedding_pos"), ("m4", "oracle_embedding_pos")))


@query("measured_stream", "fact:s n_rows:i n_queries:i total:i", _COUNTS)
def _measured(t: Fixture) -> DataFrame:
    """The queries arrive as a stream of files; every micro-batch commits all four facts at once."""
    from polyseek.streaming.measured import measured_stream

    root = folder(t.spark)
    t.qtok.select("query_id", "q_token_id", "qv").repartition(2, "query_id").write.parquet(f"{root}/in")
    measured_stream(t.spark, f"{root}/in", t.clustered, CONFIG, f"{root}/run", f"{root}/checkpoint").awaitTermination()
    run, out = Run(t.spark, f"{root}/run"), None
    for name, c in (("m1", "num_token_token_sims"), ("r0", "rank"), ("m3", "winner_embedding_pos"), ("m4", "oracle_embedding_pos")):
        one = run.read(name).agg(F.lit(name).alias("fact"), F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.sum(c).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def _measures(t: Fixture) -> Measures:
    run = Run(t.spark, folder(t.spark))
    run.add({"m1": t.m1, "r0": t.r0, "m3": t.m3, "m4": t.m4})
    return Measures(run, t.index.postings, t.index.centroids, t.index.weights)


query("loader_offline", "centroid_id:i n_tokens:i n_docs:i top_1_doc_share:f gini_coefficient:f dispersion:f isolation:f tokens_per_doc:f", "SELECT *, n_tokens / n_docs AS tokens_per_doc FROM offline")(lambda t: _measures(t)["offline"])
query("loader_online_cells", "centroid_id:i sel_freq:i yield:f traffic_share:f bad_hubness:f good_hubness:f hub_type:s", "SELECT * FROM hub")(lambda t: _measures(t)["online_cells"])
query("loader_online_queries", "query_id:i unique_centroids:i load_cv:f activation_entropy:f load_gini:f top_5_centroid_share:f", "SELECT * FROM activ")(lambda t: _measures(t)["online_queries"])
query("loader_cached", "oracle_centroid_id:i miss_count:i oracle_win_count:i miss_rate:f", "SELECT * FROM m6")(
    lambda t: (lambda m: (m["m6"], Measures(m.run, t.index.postings, t.index.centroids, t.index.weights)["m6"])[1])(_measures(t))
)
query("loader_of_queries", "query_id:i oracle_centroid_id:i miss_count:i oracle_win_count:i", "SELECT query_id, oracle_centroid_id, count(*) FILTER (WHERE is_miss) AS miss_count, count(*) AS oracle_win_count FROM m5 SEMI JOIN (SELECT query_id FROM m2 WHERE redundancy_rate > 0.5) USING (query_id) GROUP BY ALL")(
    lambda t: (lambda m: m.of_queries("m6_per_query", m["m2"].where("redundancy_rate > 0.5")))(_measures(t))
)
query("golden_scan", TOK + "doc_id:i oracle_score:f", "SELECT query_id, q_token_id, doc_id, oracle_score FROM m4 SEMI JOIN qrels USING (query_id, doc_id)")(lambda t: pairs.measured(*t.golden, ("oracle_score",)))


@query("derived_saved", "table:s n:i n_columns:i", "SELECT 'm2' AS \"table\", count(*) AS n, 5 AS n_columns FROM m2 UNION ALL SELECT 'm6', count(*), 4 FROM m6")
def _derived_saved(t: Fixture) -> DataFrame:
    """Derived tables and the JSON line that says what they hold."""
    root = folder(t.spark)
    sinks.save_derived({"m2": facts.m2(t.m1, t.m3), "m6": t.m6}, root, {"nprobe": CONFIG.nprobe})
    about = t.spark.read.json(f"{root}/summary").select(F.from_json(F.get_json_object("metadata", "$.tables"), "map<string, struct<rows: long, columns: array<string>>>").alias("m"))
    return about.select(F.explode("m").alias("table", "x")).select("table", F.col("x.rows").alias("n"), F.size("x.columns").alias("n_columns"))


# Corpora and lists.
_CORPUS = "SELECT row_number() OVER (ORDER BY length(i), i) - 1 AS pid, i AS external_id, x FROM (SELECT CAST(page_id AS VARCHAR) AS i, url || ' ' || coalesce(html, '') AS x FROM pages)"


@query("benchmark_corpus", "pid:i external_id:s hash:s", f"SELECT pid, external_id, md5(x) AS hash FROM ({_CORPUS})")
def _corpus(t: Fixture) -> DataFrame:
    """JSON lines with titles, read as a collection with dense ids and the map to the external ones."""
    root = folder(t.spark)
    sinks.save_json(t.table("pages").select(F.col("page_id").cast("string").alias("_id"), F.col("url").alias("title"), F.col("html").alias("text")), root)
    rows, ids = readers.benchmark_corpus(t.spark, root)
    return rows.join(ids.withColumnRenamed("doc_id", "pid"), "pid").select("pid", "external_id", F.md5(F.col("text").cast("binary")).alias("hash"))


query("distinct_in_order", "user_id:i place:i", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS place FROM events GROUP BY 1")(lambda t: text.distinct_in_order(t.table("events"), "user_id", "event_id"))

#: Documents of unequal length: the k-th has 2 k + 1 vectors.
_SEG = "(SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS key, vec_id, v FROM tok)"


def _segments(t: Fixture) -> DataFrame:
    rows = t.tokens.select(F.floor(F.sqrt("vec_id")).alias("key"), "vec_id", "v")
    return ragged.lists(rows, "key", "vec_id", "v")


@query("ragged_roundtrip", "key:i pos:i dim:i value:f", f"SELECT key, row_number() OVER (PARTITION BY key, d ORDER BY vec_id) - 1 AS pos, d - 1 AS dim, v[d] AS value FROM {_SEG}, range(1, 5) r(d)")
def _ragged(t: Fixture) -> DataFrame:
    """Lists, packed, padded with a mask, and back; four components of each vector to compare."""
    back = ragged.from_padded(ragged.padded(ragged.packed(_segments(t), 7)))
    back = ragged.unpacked(ragged.packed(back))
    rows = back.select("key", F.posexplode("vectors").alias("pos", "v"))
    return rows.select("key", "pos", F.posexplode(F.slice("v", 1, 4)).alias("dim", "value"))


@query("ragged_padded", "key:i n:i length:i n_mask:i", f"SELECT key, count(*) AS n, (SELECT max(k) FROM (SELECT count(*) AS k FROM {_SEG} GROUP BY key)) AS length, count(*) AS n_mask FROM {_SEG} GROUP BY key")
def _ragged_padded(t: Fixture) -> DataFrame:
    longest = t.tokens.groupBy(F.floor(F.sqrt("vec_id"))).count().agg(F.max("count")).first()[0]
    rows = ragged.padded(ragged.packed(_segments(t), 5), longest)
    return rows.select("key", "n", F.size("mask").alias("length"), F.size(F.filter("mask", lambda x: x)).alias("n_mask"))


@query("ragged_gather", "query_id:i doc_id:i n:i total:f", "SELECT query_id, doc_id, count(*) AS n, sum(list_sum(v)) AS total FROM top JOIN tok USING (doc_id) GROUP BY ALL")
def _gathered(t: Fixture) -> DataFrame:
    """The vectors of every ranked document, gathered from packed blocks by its id; a document comes once for each ranking."""
    packs = stored(ragged.packed(ragged.lists(t.tokens, "doc_id", "pos", "v"), 16))
    found = ragged.gathered(packs, t.top.select(F.col("doc_id").alias("key")).distinct())
    total = F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda s, x: s + x)
    return t.top.select("query_id", "doc_id").join(found.select(F.col("key").alias("doc_id"), F.size("vectors").alias("n"), total.alias("total")), "doc_id")


# Figures.
query("percentile_marks", "p:f value:f", "SELECT p, quantile_cont(l_extendedprice::DOUBLE, p) AS value FROM lineitem, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p) GROUP BY p".replace("quantile_cont(l_extendedprice::DOUBLE, p)", "quantile_cont(l_extendedprice::DOUBLE, [0.05, 0.25, 0.5, 0.75, 0.95])[CASE p WHEN 0.05 THEN 1 WHEN 0.25 THEN 2 WHEN 0.5 THEN 3 WHEN 0.75 THEN 4 ELSE 5 END]"))(
    lambda t: plots.percentile_marks(t.table("lineitem"), "l_extendedprice")
)
_Q = "(SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"
query("box_figures", "event_type:s n:i q1:f median:f q3:f low:f high:f outliers:i", f"SELECT event_type, count(*) AS n, q1, median, q3, min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN {_Q} USING (event_type) WHERE value IS NOT NULL GROUP BY ALL")(
    lambda t: plots.box_figures(t.table("events"), "event_type", "value")
)
query("histogram2d", "bx:i by:i n:i", "SELECT least(CAST(floor((l_quantity - 0) / (50 / 10.0)) AS BIGINT), 9) AS bx, least(CAST(floor(l_discount / (0.1 / 5)) AS BIGINT), 4) AS \"by\", count(*) AS n FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem) WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY ALL")(
    lambda t: plots.histogram2d(t.table("lineitem").select(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")), "l_quantity", "l_discount", (0.0, 50.0), (0.0, 0.1), (10, 5))
)
_DEN = "(SELECT event_type AS g, least(CAST(floor((value - a) / ((b - a) / 32)) AS BIGINT), 31) AS bin, count(*) AS c FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) WHERE value IS NOT NULL GROUP BY ALL)"
query("density", "group:s at:f density:f", f"SELECT g AS \"group\", any_value(a) + (i + 0.5) * any_value(w) AS at, sum(c * exp(-0.5 * (((i - bin) * w) / h) ** 2) / (h * sqrt(2 * pi()))) / any_value(n) AS density FROM {_DEN} JOIN (SELECT event_type AS g, stddev(value) * pow(count(value), -0.2) AS h, count(value) AS n FROM events GROUP BY 1) USING (g), (SELECT min(value) AS a, (max(value) - min(value)) / 32 AS w FROM events), range(32) r(i) GROUP BY g, i")(
    lambda t: plots.density(t.table("events"), "value", "event_type", 32)
)
query("fit_line", "x:f y:f", "SELECT unnest([a, b]) AS x, unnest([i + s * a, i + s * b]) AS y FROM (SELECT min(x) AS a, max(x) AS b, regr_intercept(y, x) AS i, regr_slope(y, x) AS s FROM (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem))")(
    lambda t: plots.fit_line(t.table("lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y")), "x", "y")
)

# Evaluation, reports, strata.
_MEAN = ", ".join(f"round(avg({m}_{k}), 5) AS {m}_{k}" for m in ("recall", "ndcg", "map") for k in (5, 10, 50, 100))
query("mean_metrics", " ".join(f"{m}_{k}:f" for m in ("recall", "ndcg", "map") for k in (5, 10, 50, 100)), f"SELECT {_MEAN} FROM ({catalog._queries['recall_at_k'][2]}) JOIN ({catalog._queries['ndcg_at_k'][2]}) USING (query_id) JOIN ({catalog._queries['map_at_k'][2]}) USING (query_id)")(
    lambda t: (lambda d: evaluate.mean_metrics(evaluate.recall_at(d, t.qrels), evaluate.ndcg_at(d, t.qrels), evaluate.map_at(d, t.qrels)))(stored(t.docs))
)
_RHO = "SELECT '{0} {1}' AS name, corr(rx, ry) AS value, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT {0} AS x, {1} AS y FROM (SELECT *, n_docs / nullif(n_tokens, 0) AS diversity FROM frame) WHERE {0} IS NOT NULL AND {1} IS NOT NULL))"
_INPUTS = " UNION ALL ".join(
    [
        *(_RHO.format(*p) for p in (("diversity", "yield"), ("diversity", "redundancy"), ("top_1_doc_share", "redundancy"), ("dispersion", "m6_miss_rate"), ("sel_freq", "redundancy"))),
        f"SELECT 'no_fallback', avg(CASE WHEN num_fallback = 0 THEN 1.0 ELSE 0 END), count(*) FROM ({catalog._queries['fallback_strength'][2]})",
        f"SELECT 'recall ' || routing_status, recall, pairs FROM ({catalog._queries['recall_by_status'][2]})",
        f"SELECT 'rescue ' || mechanism, NULL, pairs FROM ({catalog._queries['rescue_mechanism'][2]})",
    ]
)
query("report_inputs", "name:s value:f n:i", _INPUTS)(lambda t: hypotheses.report_inputs(stored(t.frame), t.fallback, stored(t.status), t.top))
query("stratify_several", "l_returnflag:s l_linestatus:s l_quantity_mean:f l_quantity_max:f l_quantity_nunique:i l_tax_mean:f l_tax_max:f l_tax_nunique:i", "SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, count(DISTINCT l_quantity) AS l_quantity_nunique, avg(l_tax) AS l_tax_mean, max(l_tax) AS l_tax_max, count(DISTINCT l_tax) AS l_tax_nunique FROM lineitem GROUP BY ALL")(
    lambda t: statistics.stratify(t.table("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"], ("mean", "max", "nunique"))
)


query("proportion_z", "n:i k:i z:f", "SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS k, (count(*) FILTER (WHERE toxic = 1) / count(*) - 0.1) / sqrt(0.1 * 0.9 / count(*)) AS z FROM labels")(
    lambda t: statistics.proportion_z(t.table("labels"), F.col("toxic") == 1, 0.1)
)

# Functions of the user's own.


@query("passage_windows", "doc_id:i start:i n:i hash:s", "SELECT doc_id, s AS start, least(60, len(ws) - s) AS n, md5(array_to_string(ws[s + 1:s + 60], ' ')) AS hash FROM words, unnest(generate_series(0, greatest(0, len(ws) - 21), 40)) u(s) WHERE len(ws) > 0")
def _windows(t: Fixture) -> DataFrame:
    """Overlapping passages of every document, by a table function of the rows' texts."""
    windows = user.passages(60, 40)
    t.spark.udtf.register("polyseek_passages", windows)
    t.table("documents").select("doc_id", "text").createOrReplaceTempView("polyseek_passages_of")
    rows = t.spark.sql("SELECT doc_id, p.* FROM polyseek_passages_of d, LATERAL polyseek_passages(d.text) p")
    return rows.select("doc_id", "start", "n", F.md5(F.col("passage").cast("binary")).alias("hash"))


query("trimmed_means", "event_type:s mean:f", "SELECT event_type, avg(value) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT * FROM (SELECT event_type, value, CAST(floor(event_id / 500) AS BIGINT) AS part FROM events WHERE value IS NOT NULL))) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY 1".replace("event_type ORDER", "event_type, part ORDER").replace("PARTITION BY event_type) AS n", "PARTITION BY event_type, part) AS n").replace("SELECT event_type, avg(value) AS mean FROM (SELECT *", "SELECT event_type, avg(m) AS mean FROM (SELECT event_type, part, avg(value) AS m FROM (SELECT *", 1).replace("GROUP BY 1", "GROUP BY ALL) GROUP BY 1"))(
    lambda t: t.table("events").where("value is not null").groupBy("event_type", F.floor(F.col("event_id") / 500).alias("part")).agg(user.trimmed_mean(0.1)("value").alias("m")).groupBy("event_type").agg(F.avg("m").alias("mean"))
)
