"""Documents from a folder of text files."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The extensions that are indexed, and folders that are not entered besides hidden ones.
EXTENSIONS = (
    "txt", "md", "rs", "py", "js", "ts", "html", "css", "json",
    "toml", "yaml", "yml", "xml", "csv", "log", "sh", "bash",
    "c", "cpp", "h", "hpp", "java", "go", "rb", "php", "swift",
    "kt", "scala", "sql", "r", "m", "tex", "org", "rst",
)
SKIPPED = ("node_modules", "target", "__pycache__")


def extension(path: Column) -> Column:
    """After the last dot of the name; none for names like ".txt"."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def is_indexable(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def list_files(folder: str) -> list[str]:
    """Indexable files below a folder, by path. Only names are read here."""
    out = []
    for place, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in SKIPPED)
        out += [os.path.join(place, n) for n in names if "." in n[1:] and n.rpartition(".")[2] in EXTENSIONS]
    return sorted(out)


def read_folder(spark: SparkSession, folder: str, first_id: int = 0) -> DataFrame:
    """(doc_id, path, title, body) of a local or mounted folder; files that are not UTF-8 are left out, ids follow paths.

    Files whose names start with "." or "_" count, which Spark's own file sources would skip; so
    paths are listed here and files are read by the tasks.
    """
    paths = list_files(folder)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with open(path, encoding="utf-8", errors="strict", newline="") as file:
                        rows.append((path, path.rsplit("/", 1)[-1], file.read()))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "title", "body"], dtype=object)

    read = listed.mapInPandas(run, "path string, title string, body string")
    return _numbered(read, first_id)


def read_store(spark: SparkSession, path: str, first_id: int = 0) -> DataFrame:
    """The same from any file system that Spark reads; hidden names, which Spark does not list, are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    skip = r"/(\.[^/]*|" + "|".join(SKIPPED) + ")/"
    own = files.where(is_indexable(F.col("path")) & ~F.substring("path", F.lit(len(path.rstrip("/")) + 1), F.length("path")).rlike(skip))
    body = F.try_validate_utf8(F.col("content").cast("string"))
    rows = own.select("path", F.element_at(F.split("path", "/"), -1).alias("title"), body.alias("body")).where("body IS NOT NULL")
    return _numbered(rows, first_id)


def _numbered(rows: DataFrame, first_id: int) -> DataFrame:
    """Ids in order of path: places within ranges of paths, plus how many come before the range."""
    ranged = rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("_part", F.spark_partition_id())
    from lexigraph.sources.tables import stage

    ranged = stage(ranged, "files")
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # a number for each partition
    before, total = {}, first_id
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    if not sizes:
        return ranged.select(F.lit(0).cast("long").alias("doc_id"), "path", "title", "body")
    offset = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])
    place = F.row_number().over(Window.partitionBy("_part").orderBy("path")) - 1
    return ranged.select((F.element_at(offset, F.col("_part")) + place).cast("long").alias("doc_id"), "path", "title", "body")
