"""Token counts: delta-maintained rollups.

Totals by source, language and tokenizer version are kept as a log of signed deltas: an insert adds a document's count, a delete takes
it away, a revision adds the difference. A batch becomes one small folder ``batch_id=.../`` of already aggregated rows, written first
under a name of the attempt's own and then renamed, so a batch is either there or not and a second delivery of it changes nothing, nor
does one at the same time. Totals are the sums over the batches; ``compact`` folds them into one. The file system must rename folders at
one stroke, as HDFS and local ones do; on a plain object store keep the log in a table format that commits.

Cases: null texts count 0 tokens; null sources, languages and versions are groups of their own; a change without counts on the side
it needs counts 0 there; a repeated change row counts as often as it occurs; an empty batch is committed and adds nothing;
very long texts are counted whole, and their counts alone travel; columns beyond those named are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import words

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """The byte-level tokenizer of a file of ranks; kept by path as long as the worker lives."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def bpe_counts(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens by the byte-level vocabulary at ``path``, for each row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(x.as_py() or "")) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    counted = docs.select("doc_id", "source", "lang", "text").mapInArrow(count, "doc_id bigint, source string, lang string, n_tokens bigint")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens")


def word_counts(docs: DataFrame, version: str = "words") -> DataFrame:
    """The same columns, counting words."""
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Deltas of a batch of changes: source, lang, tokenizer, op (insert, delete or revise), n_tokens (new), old_tokens.

    Aggregated map-side, so a hot source is a few rows a task. Other values of op add nothing.
    """
    new, old = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).when(F.col("op") == "revise", new - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """The totals under one folder of a file system that Spark and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch_id: int) -> bool:
        path, fs = self._place(f"batch_id={batch_id}")
        return fs.exists(path)

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """Commit a batch; False, and nothing changes, if it was committed before."""
        final, fs = self._place(f"batch_id={batch_id}")
        if fs.exists(final):
            return False
        name = f"_draft-{batch_id}-{uuid.uuid4().hex}"
        draft, _ = self._place(name)
        # a row a group, in as many tasks as their number asks for
        signed_deltas(changes).write.parquet(draft.toString())
        # onto a folder that came in the meantime, a rename fails or moves the draft into it, where readers ignore it
        inside, _ = self._place(f"batch_id={batch_id}/{name}")
        if fs.rename(draft, final) and not fs.exists(inside):
            return True
        fs.delete(inside, True)
        fs.delete(draft, True)
        return False

    def batches(self) -> DataFrame:
        self._place("")[1].mkdirs(self._place("")[0])
        return self.spark.read.schema(f"{DELTA}, batch_id bigint").parquet(self.path)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups that still have documents or tokens."""
        sums = self.batches().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 OR n_tokens != 0")


def compact(rollup: Rollup, path: str) -> Rollup:
    """The same totals as a single batch under ``path``; its number is that of the newest batch."""
    newest = rollup.batches().agg(F.max("batch_id")).first()[0]
    fresh = Rollup(rollup.spark, path)
    if newest is not None:
        rollup.totals().write.mode("overwrite").parquet(f"{fresh.path}/batch_id={newest}")
    return fresh
