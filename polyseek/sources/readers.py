"""Scans of collections, queries, judgements, answers, rankings and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyseek import schemas
from polyseek.operators.text import numeric_id, passage, titled, unescaped
from polyseek.sources.scratch import stored


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", quote="", escape="")


def collection(spark: SparkSession, path: str) -> DataFrame:
    """pid, text of pid \\t passage [\\t title] lines; a header line has no numeric pid and goes."""
    rows = _tsv(spark, path, "pid string, passage string, title string").where(F.col("pid").rlike("^[0-9]+$"))
    return rows.select(F.col("pid").cast("long").alias("pid"), passage(F.col("title"), unescaped(F.col("passage"))).alias("text"))


def benchmark_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A collection (pid, text) and its id map (doc_id, external_id) from JSON lines with _id, title and text. Internal ids are dense, in
    the order of the external ones (numbers by value, then other ids by code point); of repeated ids the least text stays."""
    rows = spark.read.schema("_id string, title string, text string").json(path).where("_id is not null")
    rows = rows.groupBy("_id").agg(F.min(F.struct(titled(F.col("title"), F.col("text")).alias("text"))).alias("t"))
    ids = ordered_ids(rows.select(F.col("_id").alias("external_id")))
    return ids.join(rows, F.col("external_id") == F.col("_id")).select(F.col("doc_id").alias("pid"), "t.text"), ids


def ordered_ids(ids: DataFrame) -> DataFrame:
    """doc_id (dense, from 0), external_id of distinct external ids: range-partitioned by the id, numbered within ranges, and over one
    row for each range, between them."""
    number = F.when(F.col("external_id").rlike("^[0-9]{1,18}$"), F.col("external_id").cast("long"))
    rows = ids.withColumn("_n", number).withColumn("_s", F.col("_n").isNull())
    rows = stored(rows.repartitionByRange("_s", "_n", "external_id").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_k")).select("_p", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_s", "_n", "external_id"))
    return rows.withColumn("_r", own).join(F.broadcast(sizes), "_p").select((F.col("_b") + F.col("_r") - 1).alias("doc_id"), "external_id")  # a row for each range


def misnumbered(rows: DataFrame) -> DataFrame:
    """Rows whose pid leaves 0..n-1 or comes twice: a collection must have none."""
    n = rows.count()
    bad = rows.groupBy("pid").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("pid") < 0) | (F.col("pid") >= n))
    return bad


def queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text of a .tsv file, or of JSON lines with qid / _id and question / query / text."""
    if path.endswith(".tsv"):
        return _tsv(spark, path, schemas.QUERIES)
    rows = spark.read.schema("qid string, _id string, question string, query string, text string").json(path)
    return rows.select(F.coalesce("qid", "_id").alias("qid"), F.coalesce("question", "query", "text").alias("text"))


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance of three-column files."""
    return _tsv(spark, path, schemas.QRELS)


def qrels_four(spark: SparkSession, path: str) -> DataFrame:
    """Distinct pairs of qid 0 pid 1 lines."""
    rows = _tsv(spark, path, "query_id string, x int, doc_id string, y int").where("x = 0 and y = 1")
    return rows.select("query_id", "doc_id").dropDuplicates().withColumn("relevance", F.lit(1))


def qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance of a JSON object of objects."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("query_id", "docs"))
    return rows.select("query_id", F.explode("docs").alias("doc_id", "relevance"))


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (internal), external_id of a JSON object."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "external_id"))
    return rows.select(F.col("k").cast("long").alias("doc_id"), "external_id")


def translated_qrels(qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgements on internal ids; documents that the map does not know go, numeric query ids become numbers."""
    out = qrels.withColumnRenamed("doc_id", "external_id").join(ids, "external_id").drop("external_id")
    return out.withColumn("query_num", numeric_id(F.col("query_id")))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id of JSON lines with qid and answer_pids."""
    rows = spark.read.schema("qid string, answer_pids array<bigint>").json(path)
    return rows.select(F.col("qid").alias("query_id"), F.explode(F.array_distinct("answer_pids")).alias("doc_id"))


def top_candidates(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """qid, query, candidates (pid, passage[, label]) of annotated candidate lists."""
    rows = _tsv(spark, path, "qid string, pid bigint, query string, passage string" + ", label int" * labelled)
    return rows.groupBy("qid", "query").agg(F.sort_array(F.collect_list(F.struct("pid", "passage", *["label"] * labelled))).alias("candidates"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.RANKING)


#: The fact tables whose schemas are known before they are read.
FACTS = {"m1": schemas.M1, "r0": schemas.R0, "m3": schemas.M3, "m4": schemas.M4}


def first_of(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def facts(spark: SparkSession, root: str | list[str], name: str) -> DataFrame:
    """A fact table (m1, r0, m3, m4, ...) under root, or under the first of several roots that has it, as a folder or as one
    file; filters and columns reach the scan."""
    roots = [root] if isinstance(root, str) else root
    reader = spark.read.schema(FACTS[name]) if name in FACTS else spark.read
    return reader.parquet(first_of(spark, [f"{r}/{name}{end}" for r in roots for end in ("", ".parquet")]))


class FactStore:
    """The facts of one measured run by name. Stored tables are read; of the others m2, m5 and m6 follow from the raw facts,
    m5 with the winners' cells if m4 has them or ``postings`` is given. Each table is planned once."""

    def __init__(self, spark: SparkSession, root: str | list[str], postings: DataFrame | None = None):
        self.spark, self.root, self.postings = spark, root, postings
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            try:
                self._known[name] = facts(self.spark, self.root, name)
            except FileNotFoundError:
                if name not in ("m2", "m5", "m6"):
                    raise
                self._known[name] = self._derived(name)
        return self._known[name]

    def _derived(self, name: str) -> DataFrame:
        from polyseek.operators import facts as derive

        if name == "m2":
            return derive.m2(self["m1"], self["m3"])
        if name == "m6":
            return derive.m6(self["m5"])
        m4 = self["m4"]
        if "oracle_centroid_id" not in m4.columns:
            if self.postings is None:
                raise ValueError("m5 needs the cells of the oracle winners: give postings")
            m4 = m4.join(self.postings.select(F.col("embedding_pos").alias("oracle_embedding_pos"), F.col("centroid_id").alias("oracle_centroid_id")), "oracle_embedding_pos")
        return derive.m5(m4, self["r0"], self["m3"])
