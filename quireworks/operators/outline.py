"""Outlines and progress: outline is thesis_id, chapter, section_no, title, claim, reasoning, style, refs (array of path, note)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions.text import is_blank, strip, word_count

FIELDS = ("claim", "reasoning", "style", "refs")


def outline_gaps(outline: DataFrame, overview: DataFrame, required: list[str]) -> DataFrame:
    """thesis_id, section_no, field: fields a section leaves empty, and required sections (field ``overview:<name>``) not in overview."""
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0 if c == "refs" else strip(F.col(c)) == "")
    missing = F.filter(F.array(*[F.when(empty(c), F.lit(c)) for c in FIELDS]), lambda x: x.isNotNull())
    sections = outline.select("thesis_id", "section_no", F.explode(missing).alias("field"))
    wanted = outline.select("thesis_id").distinct().withColumn("name", F.explode(F.array(*map(F.lit, required))))
    lacking = wanted.join(overview.select("thesis_id", F.col("section").alias("name")), ["thesis_id", "name"], "left_anti")
    return sections.unionByName(lacking.select("thesis_id", F.lit(None).cast("string").alias("section_no"), F.concat(F.lit("overview:"), "name").alias("field")))


def references(outline: DataFrame) -> DataFrame:
    return outline.select("thesis_id", "section_no", F.explode("refs").alias("r")).select("thesis_id", "section_no", F.col("r.path").alias("path"))


def dangling_refs(outline: DataFrame, chunks: DataFrame) -> DataFrame:
    """thesis_id, section_no, path of references to chunks (path) that don't exist."""
    return references(outline).join(chunks.select("path"), "path", "left_anti").select("thesis_id", "section_no", "path")


def ref_reuse(outline: DataFrame) -> DataFrame:
    """path, n_refs, n_sections: how often a chunk is referred to."""
    return references(outline).groupBy("path").agg(F.count("*").alias("n_refs"), F.count_distinct("thesis_id", "section_no").alias("n_sections"))


def support_gaps(outline: DataFrame, chunks: DataFrame) -> DataFrame:
    """thesis_id, section_no of sections without a reference to a chunk that exists."""
    held = references(outline).join(chunks.select("path"), "path", "left_semi")
    return outline.select("thesis_id", "section_no").join(held, ["thesis_id", "section_no"], "left_anti")


def length_plan(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """thesis_id, file, words, planned, share, in_range for lines and planned (thesis_id, file, planned).

    in_range: introductions 10 to 15 %, conclusions 5 to 8 % of the thesis; null for other files.
    """
    words = lines.groupBy("thesis_id", "file").agg(F.sum(word_count(F.col("line"))).alias("words"))
    share = F.col("words") / F.sum("words").over(Window.partitionBy("thesis_id"))
    both = words.withColumn("share", F.round(share, 6)).join(planned, ["thesis_id", "file"], "left")
    ok = F.when(F.col("file") == "introduction", F.col("share").between(0.10, 0.15)).when(F.col("file") == "conclusion", F.col("share").between(0.05, 0.08))
    return both.select("thesis_id", "file", "words", "planned", "share", ok.alias("in_range"))


def next_section(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """thesis_id, section_no: the first section of the outline (with ord) that no heading has."""
    left = outline.join(headings.select("thesis_id", "section_no"), ["thesis_id", "section_no"], "left_anti")
    return left.groupBy("thesis_id").agg(F.min_by("section_no", "ord").alias("section_no"))


def tail_context(lines: DataFrame, n_chars: int = 500, n_paragraphs: int = 2) -> DataFrame:
    """thesis_id, file, tail, previous_end of lines (thesis_id, file, file_ord, line_no, line).

    tail: a file's last characters; previous_end: the last lines with text of the file before.
    """
    w = Window.partitionBy("thesis_id", "file_ord").orderBy(F.desc("line_no"))
    full = lines.where(~is_blank(F.col("line"))).withColumn("r", F.row_number().over(w))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["line"]), "\n")
    row = F.struct("line_no", "line")
    files = full.groupBy("thesis_id", "file", "file_ord").agg(F.right(joined(row), F.lit(n_chars)).alias("tail"), joined(F.when(F.col("r") <= n_paragraphs, row)).alias("end"))
    return files.select("thesis_id", "file", "tail", F.lag("end").over(Window.partitionBy("thesis_id").orderBy("file_ord")).alias("previous_end"))


def term_order(uses: DataFrame, terms: DataFrame) -> DataFrame:
    """thesis_id, term, first_used, established of uses (thesis_id, term, file_ord) before the chapter of terms (term, established)."""
    first = uses.groupBy("thesis_id", "term").agg(F.min("file_ord").alias("first_used"))
    return first.join(terms, "term").where("first_used < established").select("thesis_id", "term", "first_used", "established")
