"""Token counts as delta-maintained rollups.

A store holds additive totals (documents and tokens by source, language and tokenizer) as the sum
of committed batches. A batch is a table of changes: inserts count +1 document and +n tokens,
deletes -1 and -n, revisions 0 and new - old. Changes are summed by key where they are, before
anything is shuffled, so a source with a third of all rows is one row a task. The sums go to a
staging folder and are moved into place under the batch's id by one rename; a batch whose id is
there already is not read again, so a retried or replayed commit changes nothing. Compaction
writes the totals so far as a new snapshot, with the ids that are new in it; ids of all snapshots
stay known, as tables that are joined, never collected. Folders that a compaction folds are removed
by the next one, so whoever reads totals meanwhile can finish.

The registered query counts each text by white-space words and by a real tokenizer, a vocabulary
file of the tokenizers library whose path is a parameter.

Defined results: changes without a number of tokens, or revisions without an old number, count as
0 tokens there; null sources, languages and tokenizers are keys of their own; an unknown kind of
change is an error; keys whose documents and tokens are all zero are left out; an empty batch is
a commit; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, need, scratch_path, ship, stage
from .packing import WordCounter, default_vocabulary, encoder_for, portions

ship(__name__)

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
WORDS_V1 = "words-v1"
#: Characters of text that are counted together.
PORTION = 1_000_000


def estimate(text: Column) -> Column:
    """A first guess, before a tokenizer has run: four characters a token."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def vocabulary_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text by a vocabulary file, without special tokens."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = encoder_for(path if Path(path).exists() else default_vocabulary(), WordCounter)
        for part in texts:
            held = part.tolist()
            yield pd.Series([n for some in portions(held, PORTION) for n in counter.count(held[some])], dtype="int64")

    return run(text)


def signed(changes: DataFrame) -> DataFrame:
    """Totals of changes (op, source, lang, tokenizer, tokens, old_tokens)."""
    need(changes, "op", *KEYS, "tokens")
    old = F.coalesce("old_tokens", F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
    new = F.coalesce("tokens", F.lit(0))
    known = F.col("op").isin("insert", "delete", "revise")
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "revise", new - old).otherwise(sign * new)
    checked = F.when(F.coalesce(known, F.lit(False)), sign).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    return changes.groupBy(*KEYS).agg(F.sum(checked).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that turn one state (doc_id, source, lang, tokenizer, tokens) into another. A document that changes its source or language is deleted and inserted."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("doc_id", *KEYS)]
    op = F.when(F.col("o._in").isNull(), "insert").when(F.col("n._in").isNull(), "delete").otherwise("revise")
    met = old.withColumn("_in", F.lit(1)).alias("o").join(new.withColumn("_in", F.lit(1)).alias("n"), same[0] & same[1] & same[2] & same[3], "full")
    key = [F.when(F.col("n._in").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in KEYS]
    tokens = F.when(F.col("n._in").isNull(), F.col("o.tokens")).otherwise(F.col("n.tokens"))
    changes = met.select(op.alias("op"), *key, tokens.alias("tokens"), F.col("o.tokens").alias("old_tokens"))
    return changes.where("op <> 'revise' OR NOT tokens <=> old_tokens")


class RollupStore:
    """Committed batches in a folder of any Hadoop file system whose rename is atomic."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _snapshot(self) -> str | None:
        return max(self._names("snapshots"), key=lambda n: int(n.split("-")[1]), default=None)

    def _held(self, snapshot: str | None) -> DataFrame:
        """(id) of the batches that a snapshot holds: those of its own folder and of all before it."""
        last = int(snapshot.split("-")[1]) if snapshot else -1
        paths = [f"{self.path}/snapshots/{n}/ids" for n in self._names("snapshots") if int(n.split("-")[1]) <= last]
        return self.spark.read.schema("id string").parquet(*paths) if paths else self.spark.createDataFrame([], "id string")

    def _publish(self, staged: str, place: str) -> bool:
        """Move a finished folder to its place, unless another one is there."""
        target = self._path(f"{self.path}/{place}")
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target) or not self.fs.rename(self._path(staged), target):
            self.fs.delete(self._path(staged), True)
            return False
        # a rename onto a folder that appeared meanwhile puts ours inside it
        inside = self._path(f"{self.path}/{place}/{staged.rsplit('/', 1)[1]}")
        if self.fs.exists(inside):
            self.fs.delete(inside, True)
            return False
        return True

    def known(self, batch_id: str) -> bool:
        """Whether a batch is committed."""
        if self.fs.exists(self._path(f"{self.path}/batches/{_folder(batch_id)}")):
            return True
        return not self._held(self._snapshot()).where(F.col("id") == batch_id).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once. False, and no effect, if its id is known."""
        if self.known(batch_id):
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        signed(changes).write.parquet(staged)
        return self._publish(staged, f"batches/{_folder(batch_id)}")

    def _parts(self) -> tuple[str | None, list[str], list[str]]:
        """The snapshot; folders of batches that are not in it, and of those that are (the last compaction's)."""
        snapshot, names = self._snapshot(), self._names("batches")
        ids = self.spark.createDataFrame([(_id(n), n) for n in names], "id string, name string")
        old = {r["name"] for r in ids.join(self._held(snapshot), "id", "left_semi").collect()}  # names of this listing
        return snapshot, [n for n in names if n not in old], sorted(old)

    def _sum(self, snapshot: str | None, fresh: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{n}" for n in fresh]
        if snapshot is not None:
            paths.append(f"{self.path}/snapshots/{snapshot}/totals")
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        snapshot, fresh, _ = self._parts()
        return self._sum(snapshot, fresh)

    def compact(self) -> bool:
        """Fold all batches into a new snapshot. What the last compaction folded goes now; ids stay known."""
        snapshot, fresh, folded = self._parts()
        if not fresh:
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self._sum(snapshot, fresh).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(_id(n),) for n in fresh], "id string").coalesce(1).write.parquet(f"{staged}/ids")
        number = int(snapshot.split("-")[1]) + 1 if snapshot else 0
        if not self._publish(staged, f"snapshots/snapshot-{number}"):
            return False
        for gone in [f"batches/{n}" for n in folded] + [f"snapshots/snapshot-{number - 2}/totals"]:
            self.fs.delete(self._path(f"{self.path}/{gone}"), True)
        return True


def _folder(batch_id: str) -> str:
    return f"batch-{batch_id.encode().hex()}"


def _id(folder: str) -> str:
    return bytes.fromhex(folder[6:]).decode()


def document_rollups(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Totals of a table's life, kept in a store.

    Three commits: every row is inserted with an estimate for each tokenizer version; the
    tokenizers' counts revise all estimates; rows whose text an earlier row has (by doc_id, null
    last) are deleted. The second commit is then replayed, and the batches are compacted. Versions
    are white-space words and the vocabulary, by its file's name.
    """
    need(docs, "doc_id", "text", "source", "lang")
    spark = docs.sparkSession
    store = RollupStore(spark, path or scratch_path(spark, "rollups"))
    vocabulary = vocabulary or default_vocabulary()
    versions = {WORDS_V1: "words", Path(vocabulary).stem: "pieces"}
    rows = stage(
        docs.select(
            "doc_id", "source", "lang", F.monotonically_increasing_id().alias("spot"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("content"),
            estimate(F.col("text")).alias("guess"), word_count(F.col("text")).alias("words"), vocabulary_count(F.col("text"), vocabulary).alias("pieces"),
        ), "counts",
    )
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("count")) for v, c in versions.items()]))
    counts = rows.select("source", "lang", "guess", each.alias("x")).select("source", "lang", "guess", "x.*")
    store.commit("load", counts.select(F.lit("insert").alias("op"), *KEYS, F.col("guess").alias("tokens")))
    revised = counts.select(F.lit("revise").alias("op"), *KEYS, F.col("count").alias("tokens"), F.col("guess").alias("old_tokens"))
    store.commit("count", revised)
    # the first row of a text: a partial minimum makes a text of a third of all rows one row a task
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang", "spot")
    firsts = rows.groupBy("content").agg(F.min(order).alias("first"))
    copies = rows.join(firsts.select("first"), (F.col("spot") == F.col("first.spot")), "left_anti")
    gone = copies.select("source", "lang", each.alias("x")).select(F.lit("delete").alias("op"), "source", "lang", "x.tokenizer", F.col("x.count").alias("tokens"))
    store.commit("copies", gone)
    store.commit("count", revised)
    store.compact()
    return store.totals()
