"""Incremental search: batches of query tokens arrive as a stream, each micro-batch appends its ranking.

A batch writes to a folder of its own and replaces it if the batch runs again, so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from polyseek.operators.index import Index
from polyseek.operators.search import search
from polyseek.plans.config import SearchConfig

TOKENS = "query_id bigint, q_token_id bigint, qv array<double>"


def search_stream(spark: SparkSession, source: str, index: Index, config: SearchConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Start searching every Parquet file that appears in source; stops by itself once all present ones are done."""

    def one(batch: DataFrame, epoch: int) -> None:
        search(batch, index, config).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream = spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
