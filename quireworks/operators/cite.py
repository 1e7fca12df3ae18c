"""Citation resolution over drafts: (thesis_id, file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions.text import strip

DEFINITION = r"^\[\^([^\]]+)\]:\s*(.*)$"
MARK = r"\[\^([^\]]+)\]"
#: The canonical order of a thesis's files.
FILE_ORDER = ["introduction", *[f"chapter{i}" for i in range(1, 9)], "conclusion"]


def chapter_order(files: DataFrame, numeric: bool = False) -> DataFrame:
    """thesis_id, file, file_ord: introduction, chapters 1 to 8, conclusion, then other chapters by name; other files are left out.

    With ``numeric``, all chapters come by number before the conclusion.
    """
    number = F.regexp_extract("file", r"^chapter(\d+)", 1)
    if numeric:
        rank = F.when(F.col("file") == "introduction", 0).when(F.col("file") == "conclusion", 1 << 30).when(number != "", number.cast("int")).when(F.col("file").startswith("chapter"), (1 << 30) + 1)
    else:
        place = F.array_position(F.array(*map(F.lit, FILE_ORDER)), F.col("file"))
        rank = F.when(place > 0, place).when(F.col("file").startswith("chapter"), len(FILE_ORDER) + 1)
    known = files.select("thesis_id", "file").distinct().withColumn("rank", rank).where("rank IS NOT NULL")
    return known.select("thesis_id", "file", F.row_number().over(Window.partitionBy("thesis_id").orderBy("rank", "file")).cast("int").alias("file_ord"))


def ordered(drafts: DataFrame) -> DataFrame:
    """Adds file_ord; lines of files outside the order are gone."""
    return drafts.join(chapter_order(drafts), ["thesis_id", "file"])


def extract_cites(lines: DataFrame) -> DataFrame:
    """thesis_id, file_ord, line_no, pos, key of every mark outside definition lines."""
    marks = F.regexp_extract_all("line", F.lit(MARK), F.lit(1))
    return lines.where(~F.col("line").rlike(DEFINITION)).select("thesis_id", "file_ord", "line_no", F.posexplode(marks).alias("pos", "key"))


def extract_defs(lines: DataFrame) -> DataFrame:
    """thesis_id, file_ord, line_no, key, defn of definition lines; indented ones are none."""
    return lines.where(F.col("line").rlike(DEFINITION)).select("thesis_id", "file_ord", "line_no", F.regexp_extract("line", DEFINITION, 1).alias("key"), strip(F.regexp_extract("line", DEFINITION, 2)).alias("defn"))


def number_keys(cites: DataFrame) -> DataFrame:
    """thesis_id, key, number in the order of first use; a key keeps its number."""
    first = cites.groupBy("thesis_id", "key").agg(F.min(F.struct("file_ord", "line_no", "pos")).alias("at"))
    return first.select("thesis_id", "key", F.row_number().over(Window.partitionBy("thesis_id").orderBy("at")).cast("int").alias("number"))


def effective_defs(defs: DataFrame) -> DataFrame:
    """thesis_id, key, defn: the last definition."""
    return defs.groupBy("thesis_id", "key").agg(F.max_by("defn", F.struct("file_ord", "line_no")).alias("defn"))


def def_conflicts(defs: DataFrame) -> DataFrame:
    """thesis_id, key, file_ord, line_no, old, new where a definition differs from the one before."""
    w = Window.partitionBy("thesis_id", "key").orderBy("file_ord", "line_no")
    return defs.withColumn("old", F.lag("defn").over(w)).where("old != defn").select("thesis_id", "key", "file_ord", "line_no", "old", F.col("defn").alias("new"))


def orphan_keys(cites: DataFrame, defs: DataFrame) -> DataFrame:
    """thesis_id, key: used, never defined."""
    return cites.select("thesis_id", "key").distinct().join(defs, ["thesis_id", "key"], "left_anti")


def rewrite_citations(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """thesis_id, file_ord, line_no, line with marks as ``[N]``; definition lines are gone.

    A line is cut at its marks; each mark joins its number, and the pieces come together in order. Lines without marks pass by.
    """
    text = lines.where(~F.col("line").rlike(DEFINITION))
    has = F.col("line").rlike(MARK)
    marked = text.where(has)
    pieces = F.arrays_zip(F.split("line", MARK, -1).alias("t"), F.regexp_extract_all("line", F.lit(MARK), F.lit(1)).alias("key"))
    cut = marked.select("thesis_id", "file_ord", "line_no", F.posexplode(pieces).alias("pos", "p")).select("thesis_id", "file_ord", "line_no", "pos", F.col("p.t").alias("t"), F.col("p.key").alias("key"))
    joined = cut.join(numbers, ["thesis_id", "key"], "left")
    piece = F.concat("t", F.when(F.col("key").isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))))
    again = joined.groupBy("thesis_id", "file_ord", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("v")))), lambda x: x["v"]), "").alias("line"))
    return text.where(~has).select("thesis_id", "file_ord", "line_no", "line").unionByName(again)


def reference_list(numbers: DataFrame, defs: DataFrame, missing: str = "[待补充]") -> DataFrame:
    """thesis_id, number, reference in order of numbers; a placeholder names keys without definition."""
    named = F.coalesce("defn", F.concat(F.lit(missing + " "), "key"))
    return numbers.join(effective_defs(defs), ["thesis_id", "key"], "left").select("thesis_id", "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), named).alias("reference"))


def merge_thesis(lines: DataFrame, references: DataFrame, title: str = "## 参考文献") -> DataFrame:
    """thesis_id and text: rewritten lines in order, then the references."""
    a = lines.select("thesis_id", F.col("file_ord").alias("a"), F.col("line_no").alias("b"), "line")
    b = references.select("thesis_id", F.lit(1 << 30).alias("a"), F.col("number").alias("b"), F.col("reference").alias("line"))
    c = lines.select("thesis_id").distinct().select("thesis_id", F.lit(1 << 30).alias("a"), F.lit(0).alias("b"), F.lit("\n" + title).alias("line"))
    rows = a.unionByName(b).unionByName(c)
    return rows.groupBy("thesis_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "line"))), lambda x: x["line"]), "\n").alias("text"))


def parse_key(keys: DataFrame) -> DataFrame:
    """Adds valid, author, work, pages and chunk of keys like ``author-work-p12-15`` or ``author-work-ch03``."""
    shape = r"^([^\sA-Z-]+)-([^\sA-Z]+?)-(?:p(\d+(?:-\d+)?)|ch(\d+))$"
    get = lambda i: F.when(F.col("key").rlike(shape), F.nullif(F.regexp_extract("key", shape, i), F.lit("")))
    return keys.select("*", F.col("key").rlike(shape).alias("valid"), get(1).alias("author"), get(2).alias("work"), get(3).alias("pages"), get(4).cast("int").alias("chunk"))


def unused(cites: DataFrame, defs: DataFrame) -> DataFrame:
    """thesis_id, key: defined, never used."""
    return defs.select("thesis_id", "key").distinct().join(cites, ["thesis_id", "key"], "left_anti")
