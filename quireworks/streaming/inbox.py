"""Incremental ingestion of an inbox: each file once, through cleaning and planning, into a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quireworks.functions.lineage import save
from quireworks.operators.clean import clean
from quireworks.plans.chunking import chunk_text, fresh_numbers, line_measures, plan_measures
from quireworks.sources.documents import to_lines

SCHEMA = "doc_id bigint, text string"


def chunks_of(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_no, provenance, body of docs (doc_id, text)."""
    fresh = save(fresh_numbers(clean(to_lines(docs))))
    return chunk_text(fresh, plan_measures(save(line_measures(fresh))).where("kind = 'chunk'"))


def ingest_stream(spark: SparkSession, inbox: str, out: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Start a run over the files of ``inbox`` that no earlier run with this checkpoint has seen; it ends by itself.

    A batch is written under its number, so one that is repeated after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks_of(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    reader = spark.readStream.schema(SCHEMA).format(file_format).load(inbox)
    return reader.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
