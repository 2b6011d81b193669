"""Tables of a corpus as Parquet, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import DELETIONS, deletions
from lexigraph.operators.index import CORPUS_STATS, DOC_STATS, POSTINGS, TERMS, Index

SCHEMAS = {
    "documents": "doc_id bigint, path string, title string, body string",
    "postings": POSTINGS,
    "doc_stats": DOC_STATS,
    "terms": TERMS,
    "corpus_stats": CORPUS_STATS,
    "deletions": DELETIONS,
    "edges": "src bigint, dst bigint",
    "pageranks": "doc_id bigint, pr double",
}
_owners = threading.local()


def file_system(spark: SparkSession, path: str):
    """Hadoop's path, and the file system that it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a temporary folder of this machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lexigraph.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
        spark.conf.set("lexigraph.shared.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in this application's part of the shared folder. It is removed with the block of ``stages`` around it, or else when the JVM ends."""
    folder = f"{shared_folder(spark)}/lexigraph-{spark.sparkContext.applicationId}"
    target, system = file_system(spark, folder)
    if not system.exists(target):
        system.mkdirs(target)
        system.deleteOnExit(target)
    path = f"{folder}/{kind}-{uuid.uuid4().hex}"
    if held := getattr(_owners, "held", None):
        held[-1].append(path)
    return path


def stage(frame: DataFrame, kind: str = "table") -> DataFrame:
    """Write the rows to a new table in the shared folder and read them from there."""
    path = scratch_path(frame.sparkSession, kind)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages in the block are removed at its end, so what is read from them must be written or collected inside."""
    held = _owners.held = getattr(_owners, "held", [])
    held.append([])
    try:
        yield
    finally:
        for path in held.pop():
            target, system = file_system(spark, path)
            system.delete(target, True)


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place in an order, from 0. A range sort spreads them over tasks, each task numbers its own, and the tasks' sizes are added up."""
    spot = F.monotonically_increasing_id()  # the task in the upper bits, the row below
    held = stage(rows.orderBy(*order).withColumn("_spot", spot), "numbered")
    tasks = held.groupBy(F.shiftright("_spot", 33).alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each task of the sort
    place = F.col("_start") + F.col("_spot").bitwiseAND((1 << 33) - 1)
    return held.join(F.broadcast(starts), F.shiftright("_spot", 33) == F.col("_task")).withColumn(name, place).drop("_spot", "_task", "_n", "_start")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a corpus, the current one last."""
    target, system = file_system(spark, f"{path}/versions")
    return sorted(int(x.getPath().getName()) for x in system.listStatus(target)) if system.exists(target) else []


def by_variant(terms: DataFrame) -> DataFrame:
    """The deletion neighbourhoods of terms, in ranges of variants and sorted, so that a lookup reads few row groups.

    Variants are hashes, so equal ranges of them are parts of equal size, without a sample. Terms, a
    small table that grows to some forty times as many rows, are dealt to as many tasks first.
    """
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright((F.shiftright("variant", 32) + (1 << 31)) * parts, 32).cast("int")
    rows = deletions(terms.repartition(parts, "term"), "term")
    return rows.repartitionById(parts, part).sortWithinPartitions("variant")


def save(path: str, index: Index, documents: DataFrame, edges: DataFrame | None = None, pageranks: DataFrame | None = None) -> int:
    """Write a corpus and give its size in bytes. Postings are ranged and sorted by term, so a filter on terms reads few row groups.

    All tables go to a new folder, which one rename makes the next version; a save that fails before
    it leaves the corpus as it was, also where the frames are read from that corpus. Versions before
    the last one are removed then: those who have the last one open can still read it.
    """
    spark, path = documents.sparkSession, path.rstrip("/")
    staged = f"{path}/staging/{uuid.uuid4().hex}"
    postings = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    postings.write.parquet(f"{staged}/postings")
    written = Index(spark.read.schema(POSTINGS).parquet(f"{staged}/postings"), index.doc_stats)
    # what a stored index already has of its postings is taken over: neighbourhoods are some forty rows for each term
    known = index.stored_terms if index.stored_terms is not None else written.terms()
    near = index.stored_deletions if index.stored_deletions is not None else by_variant(known)
    terms = known.repartitionByRange("term").sortWithinPartitions("term")
    frames = {"documents": documents, "doc_stats": index.doc_stats, "terms": terms, "corpus_stats": written.corpus_stats(), "deletions": near, "edges": edges, "pageranks": pageranks}
    for name, frame in frames.items():
        frame = spark.createDataFrame([], SCHEMAS[name]) if frame is None else frame
        frame.write.parquet(f"{staged}/{name}")
    old = versions(spark, path)
    target, system = file_system(spark, f"{path}/versions/{old[-1] + 1 if old else 1}")
    system.mkdirs(target.getParent())
    if not system.rename(file_system(spark, staged)[0], target):
        raise RuntimeError(f"another save took {target}")
    for number in old[:-1]:
        system.delete(file_system(spark, f"{path}/versions/{number}")[0], True)
    return system.getContentSummary(target).getLength()


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no corpus at {path}")
    return {name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/versions/{found[-1]}/{name}") for name, schema in SCHEMAS.items()}


def url_map(documents: DataFrame) -> DataFrame:
    """(url, doc_id): the last document of each url."""
    return documents.where("path IS NOT NULL").groupBy(F.col("path").alias("url")).agg(F.max("doc_id").alias("doc_id"))
