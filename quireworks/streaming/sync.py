"""A chunk table that follows an inbox: files that are new, changed or gone since the last commit.

A run compares the listing of the inbox (path, length, time of change; contents aren't read) with the log of committed batches, reads what is new or changed, at most ``most`` files a
batch, writes what it makes of them, and commits by renaming the batch's list of files into the log. What was written without a commit is in no reader's view and is overwritten by
the next run, which takes the same number. Of each file the newest committed batch counts; a file that is gone is committed without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions.lineage import hinted, save
from quireworks.streaming.inbox import SCHEMA, chunks_of

_FILES = "file string, path string, length bigint, modified timestamp, gone boolean"


class ChunkTable:
    """Rows made of the files of an inbox, under one folder of a file system that renames at one stroke."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> DataFrame:
        """file (its address), path, length, modified, gone and batch of every commit."""
        path, fs = self._place("log")
        fs.mkdirs(path)
        return self.spark.read.schema(f"{_FILES}, batch int").parquet(f"{self.out}/log")

    def newest(self) -> DataFrame:
        """file, path, length, modified, gone and batch, as each file was committed last."""
        return self.log().groupBy("file").agg(F.max_by(F.struct("path", "length", "modified", "gone", "batch"), "batch").alias("f")).select("file", "f.*")

    def rows(self) -> DataFrame | None:
        """What is made of the files as they were committed last, with ``file`` and ``batch``; None without files."""
        newest = save(self.newest().where("NOT gone").select("file", "batch"))
        batches = sorted(r[0] for r in newest.select("batch").distinct().collect())
        if not batches:
            return None
        read = self.spark.read.option("basePath", f"{self.out}/rows").parquet(*(f"{self.out}/rows/batch={b}" for b in batches))
        return read.join(hinted(newest, newest.count()), ["file", "batch"])

    def _changes(self, inbox: str) -> DataFrame:
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inbox)
        now = listed.select(F.col("_metadata.file_path").alias("file"), "path", "length", F.col("modificationTime").alias("modified"))
        before = self.newest().where("NOT gone").select("file", *(F.col(c).alias(f"old_{c}") for c in ("path", "length", "modified")))
        both = now.join(before, "file", "full_outer")
        changed = F.col("length").isNull() | F.col("old_length").isNull() | (F.col("length") != F.col("old_length")) | (F.col("modified") != F.col("old_modified"))
        return both.where(changed).select("file", *(F.coalesce(c, f"old_{c}").alias(c) for c in ("path", "length", "modified")), F.col("length").isNull().alias("gone"))

    def sync(self, inbox: str, file_format: str = "parquet", schema: str = SCHEMA, make: Callable[[DataFrame], DataFrame] = chunks_of, most: int = 10_000, before_commit: Callable[[int], None] = lambda batch: None) -> int:
        """Bring the table up to the inbox; the number of batches that this took. ``make`` turns rows of files into rows that keep doc_id; a doc_id is in one file."""
        done = 0
        while True:
            files = save(self._changes(inbox).orderBy("file").limit(most))
            read = [r[0] for r in files.where("NOT gone").select("path").collect()]  # ``most`` paths at most
            if files.isEmpty():
                return done
            batch = 1 + (self.log().agg(F.max("batch")).first()[0] or 0)
            if read:
                docs = save(self.spark.read.schema(schema).format(file_format).load(read).withColumn("file", F.col("_metadata.file_path")))
                origin = docs.select("doc_id", "file").distinct()
                make(docs.drop("file")).join(origin, "doc_id").write.mode("overwrite").parquet(f"{self.out}/rows/batch={batch}")
            draft = f"_drafts/{uuid.uuid4().hex}"
            files.write.parquet(f"{self.out}/{draft}")
            before_commit(batch)
            path, fs = self._place(f"log/batch={batch}")
            if fs.exists(path) or not fs.rename(self._place(draft)[0], path):
                raise RuntimeError(f"batch {batch} was committed by another run")
            done += 1
