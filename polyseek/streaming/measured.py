"""A measured stream: every micro-batch of query tokens is searched and its facts are committed together.

A batch writes M1, R0, M3, M4 and the ranking as chunks of a run under one commit: readers see all five or none. Its number
is part of the commit, so a batch that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from polyseek.operators import facts
from polyseek.operators.index import Index
from polyseek.plans.config import SearchConfig
from polyseek.sources.runs import Run
from polyseek.streaming.incremental import TOKENS


def measured_stream(spark: SparkSession, source: str, index: Index, config: SearchConfig, root: str, checkpoint: str) -> StreamingQuery:
    """Start measuring every Parquet file of query tokens that appears in source; stops once all present ones are done."""

    def one(batch: DataFrame, epoch: int) -> None:
        run = Run(batch.sparkSession, root)
        if f"stream {epoch}" not in run.manifest()["batches"]:
            run.add(facts.measure(batch, index, config), batch=f"stream {epoch}")

    stream = spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
