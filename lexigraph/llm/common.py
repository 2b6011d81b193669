"""Helpers that the training-data operators share.

Intermediate tables are written to the folder that the cluster names in
``spark.checkpoint.dir``; they cut lineage and survive the loss of executors.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.sources.tables import scratch_path, stage, stages

__all__ = ["LAST_ID", "WORD", "code_points", "configured", "id_or_last", "need", "packed", "scratch_path", "ship", "stage", "stages", "table", "text_key"]
#: White space as the operators see it, for Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Where rows without an id stand.
LAST_ID = (1 << 63) - 1
#: Rows that a Python worker gets at once in the registered queries and the pipeline; texts can be long.
BATCH_ROWS = 1_000


def ship(name: str) -> None:
    """Send this module's functions to Python workers by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def configured(run: Callable) -> Callable:
    """A query or pipeline stage, an application's entry: it sets the session's Arrow batch size where nothing else has."""

    @wraps(run)
    def with_batches(spark: SparkSession, *args) -> DataFrame:
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return run(spark, *args)

    return with_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: two among 10^12 texts meet by chance once in 10^14 corpora."""
    return F.unhex(F.md5(text.cast("binary")))


def id_or_last(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs can clash with the operators'."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def need(frame: DataFrame, *names: str) -> None:
    """Fail early, and plainly, when a column is missing."""
    if missing := [n for n in names if n not in frame.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
