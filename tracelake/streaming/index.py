"""A code graph kept up to date by batches of changed files, in tables that survive a restart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import cut, ship
from tracelake.operators import extract, resolve

_FILES = "rel_path string, content string, batch bigint"
_FACTS = extract.FACTS + ", batch bigint"


@dataclass
class Index:
    """Tables of an indexed repository; facts are kept, so that a change parses only its own files."""

    files: DataFrame
    facts: DataFrame

    @staticmethod
    def build(files: DataFrame) -> Index:
        files = files.select("rel_path", "content")
        return Index(files, cut(extract.source_facts(files)))

    def tables(self) -> dict[str, DataFrame]:
        """Nodes, edges of all kinds, references and entry points."""
        return resolve.code_graph(self.facts, self.files)

    def apply(self, changes: DataFrame) -> Index:
        """After ``changes(rel_path, content)``; a null content deletes the file. Of a file's changes in a batch there is one.

        Only changed files are parsed; joins then resolve over all facts, so the result is that of a full index.
        """
        changes = changes.select("rel_path", "content")
        files = self.files.join(changes.select("rel_path"), "rel_path", "left_anti").unionByName(changes.where("content is not null"))
        facts = self.facts.join(changes.select("rel_path"), "rel_path", "left_anti").unionByName(extract.source_facts(changes.where("content is not null")))
        return Index(cut(files), cut(facts))


@dataclass
class StoredIndex:
    """An index as a log of batches below ``folder``, which all executors share.

    A batch writes the files it changes and their facts, nothing else, into folders that its number names; one that runs
    again after a failure writes them again. The state is, of each file, what the last batch with it wrote. It needs no
    memory of the driver, so a stream goes on where it stood after a restart. ``compact`` folds the log into its first
    batch once it is long.
    """

    spark: SparkSession
    folder: str

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException:  # nothing is there yet
            return self.spark.createDataFrame([], schema)

    def write(self, number: int, changes: DataFrame) -> None:
        """``changes(rel_path, content)``, one row a file; a null content deletes the file."""
        ship(self.spark)
        one = cut(changes.select("rel_path", "content"))
        extract.source_facts(one.where("content is not null")).write.mode("overwrite").parquet(f"{self.folder}/facts/batch={number}")
        # The files come last: a batch counts once they are there.
        one.write.mode("overwrite").parquet(f"{self.folder}/files/batch={number}")

    def load(self) -> Index:
        log = self._read("files", _FILES)
        last = log.groupBy("rel_path").agg(F.max_by(F.struct("content", "batch"), "batch").alias("l")).select("rel_path", "l.content", "l.batch")
        alive = last.where("content is not null")
        facts = self._read("facts", _FACTS).join(alive.select("rel_path", "batch"), ["rel_path", "batch"], "left_semi")
        return Index(alive.select("rel_path", "content"), facts.drop("batch"))

    def compact(self, to: str) -> StoredIndex:
        """The same state as one batch below ``to``; its number is the last one folded, so later batches come after it."""
        number = self._read("files", _FILES).agg(F.max("batch").alias("n")).first()["n"]
        if number is not None:
            state = self.load()
            state.facts.write.mode("overwrite").parquet(f"{to}/facts/batch={number}")
            state.files.write.mode("overwrite").parquet(f"{to}/files/batch={number}")
        return StoredIndex(self.spark, to)


def follow(index: StoredIndex, stream: DataFrame, checkpoint: str, seen=None) -> Index:
    """Applies a stream of changed files ``(rel_path, content, changed_at)``, a micro-batch at a time, until no more is there.

    ``index`` may hold batches of before, numbered below 0 (as ``write(-1, files)`` makes them). ``seen`` gets the number
    of each batch and the state behind it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("rel_path").agg(F.max_by(F.struct("content"), "changed_at").alias("l")).select("rel_path", "l.content")
        index.write(number, last)
        if seen:
            seen(number, index.load())

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return index.load()
