"""The catalogue's common inputs: the tables of a scale folder seen as tokens, queries, judgements and an index.

A row of ``embeddings`` is a token: five make a document. Query tokens are the rows whose vec_id is divisible by 20, four
to a query, searched against all rows. The index has 16 cells around the vectors of least vec_id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.operators import clusters, facts, index, pairs, search
from polyseek.plans.config import SearchConfig
from polyseek.sources.scratch import folder, stored

CELLS, T_PRIME = 16, 40
CONFIG = SearchConfig.of(nprobe=4, t_prime=T_PRIME, k=10, nbits=4)


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tokens(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select("vec_id", F.expr("vec_id div 5").alias("doc_id"), (F.col("vec_id") % 5).alias("pos"), F.col("embedding").cast("array<double>").alias("v"), "label")

    @cached_property
    def seeds(self) -> DataFrame:
        return self.tokens.where(F.col("vec_id") < CELLS).select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv"))

    @cached_property
    def qtok(self) -> DataFrame:
        q = self.tokens.where(F.col("vec_id") % 20 == 0)
        return q.select(F.expr("vec_id div 80").alias("query_id"), F.expr("(vec_id div 20) % 4").alias("q_token_id"), F.col("v").alias("qv"), "label")

    @cached_property
    def assigned(self) -> DataFrame:
        return index.assign(self.tokens, self.seeds)

    @cached_property
    def index(self) -> index.Index:
        """Stored tables, as an index is built once and searched often; the codec is measured on all tokens."""
        built = index.build(self.tokens, self.seeds, CONFIG.nbits, heldout=F.lit(True))
        return index.Index(stored(built.postings), stored(built.centroids), built.cutoffs, built.weights)

    @cached_property
    def clustered(self) -> index.Index:
        """The index with its postings in blocks by cell, as searches read it."""
        return self.index.clustered(folder(self.spark))

    @cached_property
    def scores(self) -> DataFrame:
        return search.centroid_scores(self.qtok, self.cells)

    @cached_property
    def cells(self) -> DataFrame:
        return stored(index.cells(self.seeds, self.assigned))

    @cached_property
    def routed(self) -> DataFrame:
        return stored(search.probes(self.scores, CONFIG.nprobe))

    @cached_property
    def missing(self) -> DataFrame:
        return search.missing_scores(self.scores, T_PRIME)

    @cached_property
    def met(self) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        """Blocks of documents and of queries, and the size of these. What is made of their pairs is a plan that counts them anew
        whenever it is read: its rows grow with documents x queries and are neither shuffled nor stored."""
        return pairs.document_blocks(self.index), stored(pairs.query_blocks(self.qtok, self.routed, self.missing)), pairs.size_of(self.qtok)

    @cached_property
    def won(self) -> DataFrame:
        return pairs.winners(*self.met)

    @cached_property
    def docs(self) -> DataFrame:
        return pairs.document_scores(*self.met)

    @cached_property
    def top(self) -> DataFrame:
        """Stored: k rows of each query, which are read many times."""
        return stored(search.top_k(pairs.document_scores(*self.met, CONFIG.k), CONFIG.k))

    @cached_property
    def qrels(self) -> DataFrame:
        """Documents of which three tokens or more have a label of the query. Queries with the same labels share the count, so that the join
        by label makes documents x sets of labels and only judged pairs are met with queries."""
        own = self.qtok.where("label is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
        tokens = self.tokens.where("label is not null").groupBy("doc_id").agg(F.collect_list("label").alias("_l"))  # a document's tokens
        sets = own.select("labels").distinct()
        n = F.size(F.filter("_l", lambda x: F.array_contains(F.col("labels"), x))).cast("int")
        judged = tokens.crossJoin(facts.near(sets)).select("doc_id", "labels", n.alias("relevance")).where("relevance >= 3")
        return judged.join(facts.near(own), "labels").select("query_id", "doc_id", "relevance")

    @cached_property
    def m1(self) -> DataFrame:
        return facts.m1(self.routed)

    @cached_property
    def r0(self) -> DataFrame:
        return facts.r0(self.routed)

    @cached_property
    def m3(self) -> DataFrame:
        """Stored: a row for each ranked document and token, from their postings alone."""
        return stored(facts.m3(search.winners(search.token_scores(self.qtok, self.routed, self.index, ranking=self.top)), self.top))

    def measured(self, *columns: str) -> DataFrame:
        return pairs.measured(*self.met, columns)

    @cached_property
    def ranked(self) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        """met, with the ranked documents of each query."""
        return self.met[0], stored(pairs.query_blocks(self.qtok, self.routed, found=self.top.select("query_id", "doc_id"))), self.met[2]

    @cached_property
    def golden(self) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        """met, of judged pairs only."""
        return stored(pairs.document_blocks(self.index, qrels=self.qrels)), self.met[1], self.met[2]

    def misses(self, *by: str) -> DataFrame:
        """M5 counted by query or cell: no row of it leaves the task that makes it."""
        return pairs.misses(*self.ranked, by)

    @cached_property
    def missed_cells(self) -> DataFrame:
        """Stored: a row for each cell."""
        return stored(self.misses("oracle_centroid_id"))

    @cached_property
    def places(self) -> DataFrame:
        """Stored: how many documents come before each of M3's, by oracle evidence. Their own evidence comes from their postings alone."""
        own = facts.m4(facts.oracle_rows(self.qtok, self.top, self.index)).groupBy("query_id", "doc_id").agg(F.sum("oracle_score").alias("score"))
        return stored(pairs.oracle_places(self.met[0], stored(pairs.query_blocks(self.qtok, self.routed, found=own)), self.met[2]))

    @cached_property
    def m4(self) -> DataFrame:
        return self.measured("oracle_embedding_pos", "oracle_score", "oracle_centroid_id")

    @cached_property
    def m5(self) -> DataFrame:
        return facts.m5(self.measured("oracle_embedding_pos", "oracle_score", "oracle_centroid_id", "is_miss"), self.r0, self.m3)

    @cached_property
    def m6(self) -> DataFrame:
        """Stored: a row for each cell."""
        return stored(facts.m6(self.missed_cells))

    @cached_property
    def m4r(self) -> DataFrame:
        return facts.golden_rows(pairs.measured(*self.golden, ("oracle_embedding_pos", "oracle_score", "oracle_centroid_id", "is_miss", *facts.GOLDEN)))

    @cached_property
    def fallback(self) -> DataFrame:
        return facts.fallback_of(pairs.measured(*self.golden, ("oracle_score", "n_probed", "best_probed"), missed=True))

    @cached_property
    def status(self) -> DataFrame:
        return facts.routing_status(pairs.golden_documents(*self.golden).withColumn("any_embedding_accessible", F.col("num_accessible_centroids") > 0))

    @cached_property
    def offline(self) -> DataFrame:
        p = self.index.postings
        out = clusters.size_docs(p).join(clusters.doc_shares(p), "centroid_id").join(clusters.gini(clusters.doc_counts(p), ["centroid_id"], "n", "gini_coefficient"), "centroid_id")
        return out.join(clusters.dispersion(p, self.index.weights), "centroid_id").join(clusters.isolation(self.seeds), "centroid_id")

    @cached_property
    def freq(self) -> DataFrame:
        return clusters.selection_frequency(self.seeds, self.m1)

    @cached_property
    def yields(self) -> DataFrame:
        return clusters.yields(self.m1, self.m3, self.index.postings)

    @cached_property
    def frame(self) -> DataFrame:
        return clusters.cluster_frame(self.offline, clusters.hubs(self.freq, self.yields), self.m6, self.m1)
