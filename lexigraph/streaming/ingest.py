"""Documents that arrive as a stream: postings are appended batch by batch.

An extension; scores depend on totals of the whole corpus, so they are computed when a query is
asked and never stored. Each micro-batch writes to a folder of its own number, so that a batch
that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexigraph.operators import index as indexes


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    index = indexes.build(batch)
    index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats/batch={number}")


def ingest(documents: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that indexes a streaming DataFrame (doc_id, body). trigger: as for writeStream.trigger."""
    writer = documents.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_index(spark: SparkSession, path: str) -> indexes.Index:
    """The index over all batches so far."""
    postings = spark.read.schema(indexes.POSTINGS).parquet(f"{path}/postings").select("term", "doc_id", "tf", "dl", "positions")
    return indexes.Index(postings, spark.read.schema(indexes.DOC_STATS).parquet(f"{path}/doc_stats").select("doc_id", "dl"))
