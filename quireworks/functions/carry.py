"""Running values over the rows of a document, block by block.

A window by document puts a whole document into one task. Here the rows of a document are cut into blocks by their number; windows run within blocks, what a block hands on is one row,
and running over these rows alone gives what each block begins with. Documents of one block hand nothing on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that a block spans.
BLOCK = 100_000
_PART = "__qw_block"


def _blocks(df: DataFrame, number: str, block: int) -> DataFrame:
    return df.withColumn(_PART, F.floor(F.col(number) / block))


def _handed(ends: DataFrame, by: str, running: Column) -> DataFrame:
    """by, block and begin: what each block but a document's first begins with."""
    order = Window.partitionBy(by).orderBy(_PART)
    following = ends.withColumn("__qw_end", running)
    # a block may have nothing of its own to hand on and so no row here; it is told by the blocks before it
    until = F.coalesce(F.lead(_PART).over(order), F.col("__qw_last"))
    return following.withColumn("__qw_to", until).where(F.col("__qw_to") > F.col(_PART)).select(by, F.explode(F.sequence(F.col(_PART) + 1, F.col("__qw_to"))).alias(_PART), F.col("__qw_end").alias("__qw_begin"))


def carried(df: DataFrame, value: Column, name: str, order: tuple[str, ...] = ("line_no",), by: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the newest value that isn't null, at the row or before it; ``order`` begins with the number that blocks are cut by."""
    cut = _blocks(df, order[0], block)
    inner = F.last(value, True).over(Window.partitionBy(by, _PART).orderBy(*order))
    last = cut.groupBy(by).agg(F.max(_PART).alias("__qw_last"), F.min(_PART).alias("__qw_first")).where("__qw_last > __qw_first").select(by, "__qw_last")
    ends = cut.where(value.isNotNull()).groupBy(by, _PART).agg(F.max_by(value, F.struct(*order)).alias("__qw_value")).join(last, by)
    begin = _handed(ends, by, F.col("__qw_value"))
    return cut.withColumn("__qw_inner", inner).join(begin, [by, _PART], "left").withColumn(name, F.coalesce("__qw_inner", "__qw_begin")).drop(_PART, "__qw_inner", "__qw_begin")


def counted(df: DataFrame, flag: Column, name: str, order: tuple[str, ...] = ("line_no",), by: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the number of flagged rows, the row's own included."""
    cut = _blocks(df, order[0], block)
    inner = F.sum(flag.cast("int")).over(Window.partitionBy(by, _PART).orderBy(*order))
    last = cut.groupBy(by).agg(F.max(_PART).alias("__qw_last"), F.min(_PART).alias("__qw_first")).where("__qw_last > __qw_first").select(by, "__qw_last")
    ends = cut.where(flag).groupBy(by, _PART).agg(F.count("*").alias("__qw_n")).join(last, by)
    begin = _handed(ends, by, F.sum("__qw_n").over(Window.partitionBy(by).orderBy(_PART)))
    return cut.withColumn("__qw_inner", inner).join(begin, [by, _PART], "left").withColumn(name, F.coalesce("__qw_inner", F.lit(0)) + F.coalesce("__qw_begin", F.lit(0))).drop(_PART, "__qw_inner", "__qw_begin")
