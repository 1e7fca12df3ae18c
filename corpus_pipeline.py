"""Documents to training text: classify, drop near copies, drop repeated lines, mix sources, encode.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.

Cases: a null or empty text is scored as the empty text, has no shingles and no passages, is of size 0 and encodes to nothing; rows that repeat a doc_id and text are one document for labels, copies and
passages, and go or stay together; rows with a null doc_id are scored, never dropped as copies, and keep their passages; very long texts are worked on whole; ties go to the smaller doc_id; columns beyond those of
documents are carried through all stages but the last, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireworks.llm import bpe_stream, line_dedup, near_copies, quality_gam, source_mix
from quireworks.llm.common import save, table
from quireworks.llm.queries import tokenizer_path


#: Texts that an Arrow batch holds at most: of long ones, the default of 10,000 takes too much memory beside the heap.
BATCH_TEXTS = 1000


def _bounded(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_TEXTS:
        spark.conf.set(name, str(BATCH_TEXTS))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject."""
    _bounded(spark)
    return quality_gam.keep(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a 5-word similarity of 0.8 or more, or with SimHash fingerprints within 2 bits."""
    _bounded(spark)
    return near_copies.dedup(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages, within lines or across them, that stood earlier in the corpus."""
    _bounded(spark)
    return line_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them; one taken twice is there twice."""
    return source_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded again."""
    _bounded(spark)
    return bpe_stream.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("classify", classify), ("drop_near_copies", drop_near_copies), ("drop_repeated_lines", drop_repeated_lines), ("mix_sources", mix_sources), ("encode", encode)]

#: The classifier, fingerprints and encoder are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
