"""Measured runs: chunks of fact tables behind a manifest, and one loader for what was measured.

Every change of a run - chunks of one or several tables, a compaction - writes its files first and then one new manifest, which
names all files that count. Readers take the newest manifest, so they see all tables of a batch or none, and a change that
breaks off leaves the state before it. One writer at a time changes a run; a second one is noticed, as its manifest's number is
taken already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.sources.readers import FACTS


class Run:
    """The tables of a run under root; its name is in ``tables()`` once a chunk of it was committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self, path: str):  # noqa: ANN202
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        folder = f"{self.root}/manifests"
        fs = self._fs(folder)
        if not fs.exists(self._path(folder)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(self._path(folder))]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """tables: name -> its chunks (folder, rows, bytes); batches: those committed; gone: folders that no longer count."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "batches": [], "gone": []}
        stream = self._fs(self.root).open(self._path(f"{self.root}/manifests/{version:012d}.json"))  # one text: no job of its own
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict], dict]) -> int:
        """Write the manifest that follows the newest: to a file of its own, then renamed to its number."""
        version = self.version()
        data = json.dumps(change(self.manifest(version)), sort_keys=True).encode()
        target = self._path(f"{self.root}/manifests/{version + 1:012d}.json")
        draft = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        fs = self._fs(self.root)
        out = fs.create(draft, False)
        out.write(bytearray(data))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.root}: another writer committed version {version + 1}")
        return version + 1

    def _write(self, name: str, rows: DataFrame) -> dict:
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")
        size = self._fs(self.root).getContentSummary(self._path(f"{self.root}/{folder}")).getLength()
        return {"folder": folder, "rows": stored.count(), "bytes": int(size), "schema": rows.schema.json()}

    def add(self, tables: dict[str, DataFrame], batch: str | None = None) -> bool:
        """Add a chunk to each of the tables, all under one commit. A batch that was committed before adds nothing (False)."""
        if batch is not None and batch in self.manifest()["batches"]:
            return False
        written = {name: self._write(name, rows) for name, rows in tables.items()}

        def change(m: dict) -> dict:
            for name, chunk in written.items():
                m["tables"].setdefault(name, []).append(chunk)
            m["batches"] += [batch] if batch is not None else []
            return m

        self._commit(change)
        return True

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as of a version (default: the newest)."""
        from pyspark.sql.types import StructType

        chunks = self.manifest(version)["tables"].get(name)
        if not chunks:
            raise FileNotFoundError(f"{self.root}: no table {name}")
        schema = StructType.fromJson(json.loads(chunks[0]["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{c['folder']}" for c in chunks])

    def pending(self, queries: DataFrame, name: str) -> DataFrame:
        """Queries without rows in a table yet."""
        try:
            done = self.read(name)
        except FileNotFoundError:
            return queries
        return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")

    def compact(self, name: str, key: str = "query_id", target: int = 128 << 20) -> int:
        """Merge a table's chunks into files of about ``target`` bytes, in ranges of key and sorted by it within, so that a filter on key
        reads few of them. Chunks added meanwhile stay. Returns the number of files; the old ones go with vacuum()."""
        before = self.manifest()["tables"].get(name, [])
        if not before:
            return 0
        old = {c["folder"] for c in before}
        files = max(1, -(-sum(c["bytes"] for c in before) // target))
        rows = self.read(name)
        one = self._write(name, rows.repartitionByRange(files, key).sortWithinPartitions(*([key] + [c for c in ("q_token_id", "doc_id") if c in rows.columns])))
        if one["rows"] != sum(c["rows"] for c in before):
            raise RuntimeError(f"{name}: {one['rows']} rows after compaction, {sum(c['rows'] for c in before)} before")

        def change(m: dict) -> dict:
            m["tables"][name] = [one, *(c for c in m["tables"][name] if c["folder"] not in old)]
            m["gone"] += sorted(old)
            return m

        self._commit(change)
        return files

    def vacuum(self) -> int:
        """Delete folders that no longer count, once no reader of an older manifest is left; returns their number. Folders of changes
        that broke off go too."""
        m = self.manifest()
        live = {c["folder"] for chunks in m["tables"].values() for c in chunks}
        fs, n = self._fs(self.root), 0
        data = self._path(f"{self.root}/data")
        for table in fs.listStatus(data) if fs.exists(data) else []:
            for chunk in fs.listStatus(table.getPath()):
                folder = f"data/{table.getPath().getName()}/{chunk.getPath().getName()}"
                if folder not in live:
                    n += bool(fs.delete(chunk.getPath(), True))
        return n


class Measures:
    """One access to what an index and a run hold: raw facts, derived facts, cluster metrics, golden rows.

    Raw facts come from the run. What follows from them is derived when it is first asked for and, with ``keep``, stored in the run
    under its name, so that the next session reads it. ``queries`` restricts any fact to some query ids: few become a
    filter that reaches the scan."""

    RAW = ("m1", "r0", "m3", "m4")
    DERIVED = ("m2", "m5", "m6", "m6_per_query", "offline", "online_cells", "online_queries", "cells")
    #: Query ids that become a filter of the scan; more are met by a semi join.
    FEW = 10_000

    def __init__(self, run: Run, postings: DataFrame, centroids: DataFrame, weights: list[float], keep: bool = True):
        self.run, self.postings, self.centroids, self.weights, self.keep = run, postings, centroids, weights, keep
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in self.run.tables():
                self._known[name] = self.run.read(name)
            elif name in self.DERIVED:
                rows = self._derived(name)
                if self.keep:
                    self.run.add({name: rows}, batch=f"derived {name}")
                    rows = self.run.read(name)
                self._known[name] = rows
            else:
                raise KeyError(name)
        return self._known[name]

    def of_queries(self, name: str, queries: list[int] | DataFrame) -> DataFrame:
        """The rows of some queries: by a filter of the scan for at most ``FEW`` ids, else by a semi join."""
        rows = self[name]
        if isinstance(queries, DataFrame):
            ids = [r[0] for r in queries.select("query_id").distinct().limit(self.FEW + 1).collect()]
            if len(ids) > self.FEW:
                return rows.join(queries.select("query_id").distinct(), "query_id", "left_semi")
            queries = ids
        return rows.where(F.col("query_id").isin(list(queries)))

    def _derived(self, name: str) -> DataFrame:
        from polyseek.operators import clusters, facts

        if name == "m2":
            return facts.m2(self["m1"], self["m3"])
        if name == "m5":
            m4 = self["m4"]
            if "oracle_centroid_id" not in m4.columns:
                at = self.postings.select(F.col("embedding_pos").alias("oracle_embedding_pos"), F.col("centroid_id").alias("oracle_centroid_id"))
                m4 = m4.join(at, "oracle_embedding_pos")
            return facts.m5(m4, self["r0"], self["m3"])
        if name == "m6":
            return facts.m6(self["m5"])
        if name == "m6_per_query":
            return facts.m6(self["m5"], ("query_id",))
        if name == "offline":
            p = self.postings
            out = clusters.size_docs(p).join(clusters.doc_shares(p), "centroid_id").join(clusters.gini(clusters.doc_counts(p), ["centroid_id"], "n", "gini_coefficient"), "centroid_id")
            return clusters.tokens_per_doc(out.join(clusters.dispersion(p, self.weights), "centroid_id").join(clusters.isolation(self.centroids), "centroid_id"))
        if name == "online_cells":
            return clusters.hubs(clusters.selection_frequency(self.centroids, self["m1"]), clusters.yields(self["m1"], self["m3"], self.postings))
        if name == "online_queries":
            return clusters.query_activation(self["m1"]).join(clusters.evidence_recall(self["m3"], self["m4"]), "query_id", "left")
        return clusters.cluster_frame(self["offline"], self["online_cells"], self["m6"], self["m1"])

    def golden(self, qrels: DataFrame) -> DataFrame:
        """M4 rows of judged pairs."""
        from polyseek.operators import facts

        return facts.golden_scan(self["m4"], qrels)


def typed(name: str, rows: DataFrame) -> DataFrame:
    """Rows with the fixed schema of a raw fact, and what columns they have beside it."""
    fixed = [f.split() for f in FACTS[name].split(", ")]
    return rows.select(*[F.col(c).cast(k).alias(c) for c, k in fixed], *[c for c in rows.columns if c not in {f[0] for f in fixed}])
