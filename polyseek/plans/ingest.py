"""Queries of scans, sinks, tokenisation and the whole index build. What a scan reads is written first, from the tables of a
scale folder, to the shared scratch folder in the scan's own format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.operators import index, search, text
from polyseek.plans.catalog import query
from polyseek.plans.fixture import CONFIG, Fixture
from polyseek.sources import readers, sinks
from polyseek.sources.scratch import folder, stored

_USERS = "SELECT conv_id || '-' || turn AS qid, text FROM conversations WHERE role = 'user' AND length(text) > 0"


def _users(t: Fixture) -> DataFrame:
    return t.table("conversations").where("role = 'user' and length(text) > 0").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")


@query("collection_tsv_roundtrip", "pid:i hash:s", r"SELECT doc_id AS pid, md5(text) AS hash FROM documents WHERE length(text) > 0 AND NOT contains(text, '\n') AND NOT contains(text, '\r') AND NOT contains(text, '\t')")
def _collection(t: Fixture) -> DataFrame:
    """Texts that hold a written-out escape cannot come back, in this format, as they were."""
    root = folder(t.spark)
    rows = t.table("documents").where("length(text) > 0").where(~F.contains("text", F.lit("\\n")) & ~F.contains("text", F.lit("\\r")) & ~F.contains("text", F.lit("\\t")))
    sinks.save_collection(rows.select(F.col("doc_id").alias("pid"), "text"), f"{root}/collection.tsv")
    return readers.collection(t.spark, f"{root}/collection.tsv").select("pid", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("collection_titles_scan", "pid:i text:s", "SELECT c_custkey AS pid, c_mktsegment || ' | ' || c_name AS text FROM customer")
def _titles(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    t.table("customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("passage"), F.col("c_mktsegment").alias("title")).write.csv(root, sep="\t", quote="", escape="", header=True)
    return readers.collection(t.spark, root)


@query("collection_misnumbered", "pid:i n:i", "SELECT c_custkey AS pid, 1 AS n FROM customer WHERE c_custkey >= (SELECT count(*) FROM customer)")
def _misnumbered(t: Fixture) -> DataFrame:
    return readers.misnumbered(t.table("customer").select(F.col("c_custkey").alias("pid")))


@query("queries_tsv_scan", "qid:s hash:s", f"SELECT qid, md5(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' ')) AS hash FROM ({_USERS})")
def _queries_tsv(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    sinks.save_queries(_users(t).withColumn("text", F.translate("text", "\n\r\t", "   ")), f"{root}/queries.tsv")
    return readers.queries(t.spark, f"{root}/queries.tsv").select("qid", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("queries_json_scan", "qid:s hash:s", f"SELECT qid, md5(text) AS hash FROM ({_USERS})")
def _queries_json(t: Fixture) -> DataFrame:
    """Half of the lines use the one pair of names, half the other."""
    root, rows = folder(t.spark), _users(t)
    even = F.pmod(F.crc32(F.col("qid").cast("binary")), F.lit(2)) == 0
    sinks.save_json(rows.where(even).withColumnRenamed("text", "question"), root)
    sinks.save_json(rows.where(~even).withColumnRenamed("qid", "_id"), root, "resume")
    return readers.queries(t.spark, root).select("qid", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("qrels_tsv_scan", "query_id:s doc_id:s relevance:i", "SELECT query_id, doc_id, relevance FROM qrels")
def _qrels_tsv(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    t.qrels.write.csv(root, sep="\t")
    return readers.qrels_tsv(t.spark, root)


@query("qrels_four_scan", "query_id:s doc_id:s relevance:i", "SELECT query_id, doc_id, 1 AS relevance FROM qrels")
def _qrels_four(t: Fixture) -> DataFrame:
    """Each line twice, and one that does not count."""
    root = folder(t.spark)
    rows = t.qrels.select("query_id", F.lit(0).alias("x"), "doc_id", F.lit(1).alias("y"))
    rows.union(rows).union(rows.limit(1).withColumn("y", F.lit(0))).write.csv(root, sep="\t")
    return readers.qrels_four(t.spark, root)


@query("qrels_json_translated", "query_num:i doc_id:i relevance:i", "SELECT query_id AS query_num, doc_id, relevance FROM qrels WHERE doc_id % 3 <> 0")
def _qrels_json(t: Fixture) -> DataFrame:
    """Judgements on external ids, of which the map knows those of documents not divisible by 3."""
    root = folder(t.spark)
    docs = t.qrels.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("D"), "doc_id"), "relevance"))).alias("d"))
    docs.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("query_id").cast("string"), "d")))).alias("value")).coalesce(1).write.text(f"{root}/qrels")
    ids = t.tokens.where("doc_id % 3 <> 0").select("doc_id").distinct()
    ids.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.concat(F.lit("D"), "doc_id"))))).alias("value")).coalesce(1).write.text(f"{root}/map")
    return readers.translated_qrels(readers.qrels_json(t.spark, f"{root}/qrels"), readers.id_map(t.spark, f"{root}/map"))


@query("top_candidates_scan", "qid:s n:i first_pid:i last_passage:s n_labelled:i", "SELECT query_id AS qid, count(*) AS n, min(doc_id) AS first_pid, arg_max('p' || doc_id, doc_id) AS last_passage, count(*) FILTER (WHERE rank <= 3) AS n_labelled FROM top GROUP BY 1")
def _candidates(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    t.top.select("query_id", "doc_id", F.concat(F.lit("q"), "query_id"), F.concat(F.lit("p"), "doc_id"), (F.col("rank") <= 3).cast("int")).write.csv(root, sep="\t")
    c = F.col("candidates")
    return readers.top_candidates(t.spark, root, labelled=True).select("qid", F.size(c).alias("n"), c[0]["pid"].alias("first_pid"), F.element_at(c, -1)["passage"].alias("last_passage"), F.size(F.filter(c, lambda x: x["label"] == 1)).alias("n_labelled"))


@query("ranking_roundtrip", "query_id:s doc_id:i rank:i score:f", "SELECT query_id, doc_id, rank, score FROM top")
def _ranking(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    sinks.save_ranking(t.top, f"{root}/ranking.tsv", sinks.provenance(nprobe=CONFIG.nprobe))
    return readers.ranking(t.spark, f"{root}/ranking.tsv")


@query("ranking_sidecar", "nprobe:i rows:i queries:i has_time:b has_arguments:b", "SELECT 4 AS nprobe, count(*) AS rows, count(DISTINCT query_id) AS queries, true AS has_time, true AS has_arguments FROM top")
def _sidecar(t: Fixture) -> DataFrame:
    root, top = folder(t.spark), stored(t.top)
    n = top.agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries")).first().asDict()
    sinks.save_ranking(top, f"{root}/ranking.tsv", sinks.provenance(nprobe=CONFIG.nprobe, **n))
    about, of = t.spark.read.json(f"{root}/ranking.tsv.meta"), lambda k: F.get_json_object("metadata", f"$.{k}")
    return about.select(of("nprobe").alias("nprobe"), of("rows").alias("rows"), of("queries").alias("queries"), of("time").isNotNull().alias("has_time"), of("arguments").isNotNull().alias("has_arguments"))


@query("answers_scan", "query_id:s doc_id:i", "SELECT query_id, doc_id FROM qrels")
def _answers(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    sinks.save_json(t.qrels.groupBy(F.col("query_id").cast("string").alias("qid")).agg(F.flatten(F.array(F.collect_list("doc_id"), F.collect_list("doc_id"))).alias("answer_pids")), root)
    return readers.answers(t.spark, root)


@query("facts_resumed", "query_id:i q_token_id:i centroid_id:i num_token_token_sims:i", "SELECT query_id, q_token_id, centroid_id, num_token_token_sims FROM m1")
def _facts(t: Fixture) -> DataFrame:
    """A run that broke off half way, resumed with all of its queries; read from the second of two roots."""
    root, kinds = folder(t.spark), "cast(query_id as int), cast(q_token_id as tinyint), cast(centroid_id as int), cast(num_token_token_sims as int)".split(", ")
    rows = t.m1.selectExpr(*kinds)
    sinks.save_facts(rows.where("query_id % 2 = 0"), f"{root}/b", "m1")
    sinks.save_facts(rows, f"{root}/b", "m1")
    return readers.facts(t.spark, [f"{root}/a", f"{root}/b"], "m1")


@query("fact_store_m6", "oracle_centroid_id:i miss_count:i oracle_win_count:i miss_rate:f", "SELECT * FROM m6")
def _store(t: Fixture) -> DataFrame:
    """Misses of each cell, derived from stored raw facts only."""
    root = folder(t.spark)
    for name, rows in (("r0", t.r0), ("m3", t.m3), ("m4", t.m4.drop("oracle_centroid_id"))):
        types = {f.split()[0]: f.split()[1] for f in readers.FACTS[name].split(", ")}
        # Scores stay doubles here, so that ties fall as they do without the detour.
        sinks.save_facts(rows.select(*[F.col(c).cast("double" if k == "float" else k).alias(c) for c, k in types.items()]), root, name)
    store = readers.FactStore(t.spark, root, t.index.postings)
    for name in ("r0", "m3", "m4"):
        store._known[name] = t.spark.read.parquet(f"{root}/{name}")
    return store["m6"]


@query("query_tokenise_marked", "conv_id:i turn:i n:i tokens:s", r"SELECT conv_id, turn, 32 AS n, array_to_string(list_concat(t, list_transform(range(32 - len(t)), lambda x: '[MASK]')), ' ') AS tokens FROM (SELECT conv_id, turn, list_concat(list_concat(['[CLS]', '[Q]'], list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:29]), ['[SEP]']) AS t FROM conversations WHERE role = 'user')")
def _marked_query(t: Fixture) -> DataFrame:
    rows = t.table("conversations").where("role = 'user'").withColumn("t", text.marked_query(text.tokens(F.col("text"), text.QUERY_TOKENS)))
    return rows.select("conv_id", "turn", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("query_tokenise_full_length", "conv_id:i turn:i most:i n:i", r"SELECT conv_id, turn, least(500, greatest(32, n + 3)) AS most, least(500, greatest(32, n + 3)) + 4 AS n FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role = 'user')")
def _full_query(t: Fixture) -> DataFrame:
    """Each query as long as it needs, within limits, with a context of three tokens behind it."""
    rows = t.table("conversations").where("role = 'user'").withColumn("w", text.tokens(F.col("text"), text.LONGEST_QUERY))
    rows = rows.withColumn("most", text.clamped_length(F.size(text.tokens(F.col("text"), 1 << 20)) + 3))
    out = F.size(text.marked_query(F.col("w"), F.col("most"), F.array(*map(F.lit, "abc"))))
    return rows.select("conv_id", "turn", "most", out.alias("n"))


@query("doc_tokenise_marked", "doc_id:i batch:i slot:i place:i n:i n_pad:i", "SELECT doc_id, r // 32 AS batch, r % 32 AS slot, place, max(n) OVER (PARTITION BY r // 32) AS n, max(n) OVER (PARTITION BY r // 32) - n AS n_pad FROM (SELECT *, row_number() OVER (ORDER BY n, place) - 1 AS r FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, 3 + len(ws[1:509]) AS n FROM words))")
def _marked_docs(t: Fixture) -> DataFrame:
    rows = text.marked_documents(t.table("documents").withColumn("w", text.tokens(F.coalesce("text", F.lit("")), text.DOC_TOKENS)), "doc_id", F.col("w"), 32)
    return rows.select("doc_id", "batch", "slot", "place", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda x: x == text.PAD)).alias("n_pad"))


@query("grouper_padded", "group:i n:i n_null:i", 'SELECT p // 7 AS "group", 7 AS n, 7 - count(*) AS n_null FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) GROUP BY 1')
def _grouper(t: Fixture) -> DataFrame:
    rows = text.padded_groups(t.table("documents").select("doc_id", "lang"), "doc_id", "doc_id", 7)
    return rows.select("group", F.size("items").alias("n"), F.size(F.filter("items", lambda x: x.isNull())).alias("n_null"))


@query("zip_lists", "vec_id:i i:i a:f b:f", "SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS a, unnest(list_transform(range(64), lambda i: v[1 + i % 5])) AS b FROM tok")
def _zip(t: Fixture) -> DataFrame:
    rows = t.tokens.select("vec_id", F.posexplode(text.zipped_to_first(F.col("v"), F.slice("v", 1, 5))).alias("i", "x"))
    return rows.select("vec_id", "i", "x.a", "x.b")


@query("zipstar_lists", "vec_id:i i:i a:f b:f", "SELECT vec_id, i, v[i + 1] AS a, CASE WHEN i < 5 THEN v[64 - i] END AS b FROM tok, range(64) r(i)")
def _zipstar(t: Fixture) -> DataFrame:
    rows = t.tokens.withColumn("w", F.slice(F.reverse("v"), 1, 5)).select("vec_id", F.posexplode(text.zipped(F.col("v"), F.col("w"))).alias("i", "x"))
    return rows.select("vec_id", "i", F.col("x.v").alias("a"), F.col("x.w").alias("b"))


_SPLIT = "SELECT vec_id, h <= greatest(1, least(CAST(floor(0.05 * n) AS BIGINT), 50000)) AS heldout FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('12346_' || vec_id), vec_id) AS h, count(*) OVER () AS n FROM tok SEMI JOIN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM tok) ORDER BY md5('12345_' || doc_id), doc_id LIMIT (SELECT least(1 + CAST(floor(16 * sqrt(120 * count(DISTINCT doc_id))) AS BIGINT), count(DISTINCT doc_id)) FROM tok)) USING (doc_id))"
query("index_sample_split", "vec_id:i heldout:b", _SPLIT)(lambda t: index.sample_split(t.tokens))
query("codec_heldout", "i:i cutoff:f weight:f", f"SELECT i, quantile_cont(x, [i / 16.0 FOR i IN range(1, 16)])[i] AS cutoff, quantile_cont(x, [(i + 0.5) / 16.0 FOR i IN range(16)])[i] AS weight FROM (SELECT unnest(r) AS x FROM res JOIN ({_SPLIT}) USING (vec_id) WHERE heldout), range(1, 17) q(i) GROUP BY i")(
    lambda t: index.codec_frame(index.residuals(index.assign(index.sample_split(t.tokens).where("heldout"), t.seeds)), 4).select(F.posexplode("weights").alias("p", "weight"), "cutoffs").select((F.col("p") + 1).alias("i"), F.get("cutoffs", F.col("p")).alias("cutoff"), "weight")
)


@query("index_build_from_sample", "n_embeddings:i n_positions:i last_pos:i sum_sizes:i", "SELECT count(*) AS n_embeddings, count(*) AS n_positions, count(*) - 1 AS last_pos, count(*) AS sum_sizes FROM tok")
def _sampled_build(t: Fixture) -> DataFrame:
    """The whole build from tokens alone: sample, cells, held-out codec, all postings."""
    return index.integrity(index.build_from_sample(t.tokens, rounds=1, cells_=32))


@query("search_loaded_index", "query_id:i doc_id:i rank:i score:f", "SELECT query_id, doc_id, rank, score FROM top")
def _loaded(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    t.index.save(root)
    return search.search(t.qtok, index.Index.load(t.spark, root), CONFIG)


@query("index_metadata", "num_passages:i num_chunks:i num_embeddings:i num_partitions:i avg_doclen:f nbits:i", "SELECT count(DISTINCT doc_id) AS num_passages, CAST(ceil(count(DISTINCT doc_id) / 25000) AS BIGINT) AS num_chunks, count(*) AS num_embeddings, count(DISTINCT centroid_id) AS num_partitions, count(*) / count(DISTINCT doc_id) AS avg_doclen, 4 AS nbits FROM post")
def _metadata(t: Fixture) -> DataFrame:
    root = folder(t.spark)
    t.index.save(root)
    return t.spark.read.schema("num_passages long, num_chunks long, num_embeddings long, num_partitions long, avg_doclen double, nbits int").json(f"{root}/metadata")
