"""Documents as numbered lines; plan texts; the inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions.text import lines_of, strip

#: Fixed value: a row of a rendered chunk plan.
PLAN_ROW = r"^chunk-(\d+[a-z]?)\s+\[行(\d+)-(\d+),\s*~?(\d+)[字词]\]\s+#\s*(.+?)(?:\s*\|\s*(.*))?$"
ROUTES = {"epub": "epub", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "pdf": "pdf-unsupported"}


def scan_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """path, doc_id, route, length and modified of the files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    route = F.lit("unknown")
    for name, to in ROUTES.items():
        route = F.when(extension == name, to).otherwise(route)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("doc_id"), route.alias("route"), "length", "modified")


def to_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1) and line; texts without a character, and null ones, have no lines."""
    return docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("int").alias("line_no"), "line")


def parse_plan(lines: DataFrame) -> DataFrame:
    """doc_id, raw_id, start, end, units, heading, warnings of the chunk rows of plan texts; contents rows and others are skipped."""
    row = strip(F.col("line"))
    get = lambda i: F.regexp_extract(row, PLAN_ROW, i)
    found = lines.where(row.rlike(PLAN_ROW)).select("doc_id", get(1).alias("raw_id"), get(2).cast("int").alias("start"), get(3).cast("int").alias("end"), get(4).cast("long").alias("units"), strip(get(5)).alias("heading"), get(6).alias("w"))
    return found.withColumn("warnings", F.when(F.col("w") == "", F.array().cast("array<string>")).otherwise(F.split("w", r"\s*\|\s*"))).drop("w")


def write_chunks(chunk_text: DataFrame, path: str, buckets: int = 16) -> None:
    """Chunk texts as Parquet; all chunks of a document lie in one bucket folder."""
    bucketed = chunk_text.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket").sortWithinPartitions("doc_id", "chunk_no").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_chunk_table(chunk_text: DataFrame, name: str, path: str, buckets: int = 16) -> DataFrame:
    """Chunk texts as the table ``name``, bucketed by document: what joins or groups it by doc_id, or by doc_id and chunk_no beside another table of as many buckets,
    moves none of its rows. The table, read back."""
    dealt = chunk_text.repartition(buckets, "doc_id").write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id", "chunk_no")
    dealt.option("path", path).saveAsTable(name)
    return chunk_text.sparkSession.table(name)
