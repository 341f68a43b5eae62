"""Writing collections, rankings, facts and reports."""

from __future__ import annotations

import json
import subprocess
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.operators.index import Index
from polyseek.operators.text import escaped

MODES = {False: "errorifexists", True: "overwrite", "reuse": "ignore", "resume": "append"}


def save_collection(rows: DataFrame, path: str, overwrite: object = False) -> None:
    rows.select("pid", escaped(F.col("text")).alias("passage")).write.mode(MODES[overwrite]).csv(path, sep="\t", quote="", escape="")


def save_queries(rows: DataFrame, path: str, overwrite: object = False) -> None:
    rows.select("qid", "text").write.mode(MODES[overwrite]).csv(path, sep="\t", quote="", escape="")


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder, as an overwriting build does first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def provenance(**more: object) -> dict:
    """What made a result: revision of the working folder's repository (null outside one), time, arguments, settings."""
    try:
        got = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
        revision = got.stdout.strip() or None
    except OSError:
        revision = None
    return {"revision": revision, "time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "arguments": sys.argv[1:], **more}


def save_json(rows: DataFrame, path: str, overwrite: object = False) -> None:
    rows.write.mode(MODES[overwrite]).json(path)


def save_ranking(rows: DataFrame, path: str, about: dict, overwrite: object = False) -> None:
    """The ranking as TSV and, beside it, what made it as one JSON line."""
    rows.select("query_id", "doc_id", "rank", "score").write.mode(MODES[overwrite]).csv(path, sep="\t")
    save_json(_one(rows.sparkSession, about), f"{path}.meta", overwrite)


def _one(spark: SparkSession, about: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "metadata string")


def save_facts(rows: DataFrame, root: str, name: str, overwrite: object = "resume") -> None:
    """Write facts; to resume leaves out queries that the table has already, so a repeated run adds none twice."""
    if overwrite == "resume":
        try:
            rows = pending(rows, rows.sparkSession.read.parquet(f"{root}/{name}"))
        except AnalysisException:  # nothing there yet
            pass
    rows.write.mode(MODES[overwrite]).parquet(f"{root}/{name}")


def pending(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries without rows in ``done`` yet: what a resumed run has left to do."""
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")


def index_bytes(spark: SparkSession, path: str) -> int:
    """Size of an index folder, all files."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength())


def index_size(index: Index) -> DataFrame:
    """(part, bytes) of an index by what it must hold: codes (nbits of each component), ids and positions of its embeddings (8 bytes
    each), centroids in single precision, and their sizes."""
    n, width = index.postings.count(), index.centroids.agg(F.max(F.size("cv"))).first()[0] or 0
    k = index.centroids.count()
    per = 8 // index.nbits
    rows = [("codes", n * -(-width // per)), ("ids", 16 * n), ("centroids", 4 * width * k), ("sizes", 8 * k)]
    return index.postings.sparkSession.createDataFrame(rows, "part string, bytes long")


def save_derived(tables: dict[str, DataFrame], root: str, about: dict, overwrite: object = True) -> None:
    """Derived tables as Parquet under root and a summary of them (rows, columns, what made them) as one JSON line."""
    spark, sizes = None, {}
    for name, rows in tables.items():
        rows.write.mode(MODES[overwrite]).parquet(f"{root}/{name}")
        spark = rows.sparkSession
        sizes[name] = {"rows": spark.read.schema(rows.schema).parquet(f"{root}/{name}").count(), "columns": rows.columns}
    if spark is not None:
        save_json(_one(spark, {"tables": sizes, **about}), f"{root}/summary", overwrite)
