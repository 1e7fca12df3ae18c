"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small rows, a dozen megabytes, up to which they are broadcast.
BROADCAST_ROWS = 50_000
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and Spark runs locally."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: a lost executor costs no recomputation, and the plan starts anew."""
    path = _new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, by: str, buckets: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """As ``save``, dealt into buckets by a column: joins, windows and aggregates by it read their buckets without another exchange."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _new_folder(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    writer = df.repartition(n, by).write.bucketBy(n, by)
    (writer.sortBy(by, *order) if order else writer).option("path", path).saveAsTable(name)
    return spark.table(name)


def _new_folder(spark: SparkSession) -> str:
    return f"{_FOLDER.get() or shared_dir(spark)}/quireworks-{uuid.uuid4().hex}"


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``save(make())``; what ``save`` wrote while ``make`` ran is deleted then."""
    folder = _new_folder(spark)
    token = _FOLDER.set(folder)
    try:
        df = make()
    finally:
        _FOLDER.reset(token)
    try:
        return save(df)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hinted(small: DataFrame, n: int) -> DataFrame:
    """Broadcast if the ``n`` rows, of some 250 bytes each, are few; else the join shuffles, and splits hot groups."""
    return F.broadcast(small) if n <= BROADCAST_ROWS else small
