"""Noise cleaning of numbered lines: (doc_id, line_no, line) to (doc_id, line_no, line).

The order of the whole job is fixed: page breaks are merged first; then lines are dropped, soft hyphens repaired, typesetting lines
dropped, formulas restored, and repeated titles removed. Windows are by document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quireworks.functions.arrow import strip_math
from quireworks.functions.carry import BLOCK, counted
from quireworks.functions.lineage import hinted, save
from quireworks.functions.text import HEADING, heading_level, heading_text, is_blank, lstrip, rstrip, strip

#: The shapes of noise.
REMOTE_IMAGE = r"^!\[image\]\(https?://"
PAGE_NUMBER = r"(?U)^\s*(\d+|\[\d+\])\s*$"
SPACED_LETTERS = r"(?U)^[A-Za-z](?:\s+[A-Za-z0-9])+\s*$"
SOFT_HYPHEN = r"(?U)([A-Za-z])Â\s*([A-Za-z])"
TYPESET = r"\$[^$]*\\(?:mathrm|times|mathbf|text|rm|bf|it|tt|sf|sc)[^$]*\$"
INLINE_MATH = r"\$[^$\n]{1,120}\$"
SENTENCE_END = "[.?!;:\"')\\]）」』。？！；：”](?U)\\s*$"
ENDS = ".?!;:\"')]）」』。？！；：”"
CONTINUES = "^[a-z,;(‘“\"']"
PAGE_MARKER = r"(?U)^\[\d+\]\s*$"
FOOTNOTE_SHORT = r"^\d{1,3}(?U)\s+(Ibid\.|See\s|Cf\.\s|Id\.,)"


def _by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def drop_noise_lines(lines: DataFrame) -> DataFrame:
    """Without remote images, page numbers standing alone and letter-spaced lines."""
    return lines.where(_is_text(F.col("line")))


def _is_text(line: Column) -> Column:
    return ~line.rlike(REMOTE_IMAGE) & ~line.rlike(PAGE_NUMBER) & ~line.rlike(SPACED_LETTERS)


def soft_hyphen(line: Column) -> Column:
    return _where(line, "Â", F.regexp_replace(line, SOFT_HYPHEN, "$1$2"))


def _where(line: Column, sign: str, changed: Column) -> Column:
    """``changed`` for lines with the sign that a change asks for; others aren't searched for its patterns."""
    return F.when(line.contains(sign), changed).otherwise(line)


def repair_soft_hyphen(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", soft_hyphen(F.col("line")))


def drop_typeset(lines: DataFrame) -> DataFrame:
    """Without lines that hold a font command in a formula and fewer than 10 characters beside formulas."""
    return lines.where(~_is_typeset(F.col("line")))


def _is_typeset(line: Column) -> Column:
    rest = F.length(strip(F.regexp_replace(line, INLINE_MATH, "")))
    return line.contains("$") & line.rlike(TYPESET) & (rest < 10)


def simple_math(line: Column) -> Column:
    """Leading brackets, note numbers, page ranges and plain numbers out of their dollar signs."""
    steps = [
        (r"^\[(?U)\s*\$\s*([①-⑩\d]+)\s*\$", "$1"),
        (r"(?U)\$\s*([①②③④⑤⑥⑦⑧⑨⑩])\s*\$", "$1"),
        (r"\$\[(\d+)\]\$", "[$1]"),
        (r"\$\[?(\d+)\\sim(\d+)\]?\$(?:(?U)\s*\$\[?\d+\\sim\d+\]?\$)?", "$1–$2"),
        (r"\$(\d+)-(\d+)\$", "$1–$2"),
        (r"\$(\d+)\$", "$1"),
    ]
    told = line
    for pattern, to in steps:
        told = F.regexp_replace(told, pattern, to)
    return _where(line, "$", told)


def restore_latex_simple(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", simple_math(F.col("line")))


def strip_inline_math(lines: DataFrame) -> DataFrame:
    """What is left of formulas as plain text; only lines with a dollar sign go to Python, others as nulls."""
    line = F.col("line")
    return lines.withColumn("line", F.coalesce(strip_math(F.when(line.contains("$"), line)), line))


def dedupe_h1(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """Without the later lines of a level-1 title that the raw lines hold more than once in the document."""
    return _without_later(cleaned, raw.select("doc_id", _title().alias("t")))


def _title() -> Column:
    return F.when(heading_level(F.col("line")) == 1, heading_text(F.col("line")))


def _without_later(cleaned: DataFrame, titles: DataFrame) -> DataFrame:
    """Only titles (doc_id, t) are counted and ranked; a line's text meets but the numbers of the lines that go."""
    again = titles.where("t IS NOT NULL").groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rank = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("line_no"))
    ranked = cleaned.select("doc_id", "line_no", _title().alias("t")).where("t IS NOT NULL").join(again, ["doc_id", "t"], "left_semi").withColumn("r", rank)
    gone = save(ranked.where("r > 1").select("doc_id", "line_no"))
    return cleaned.select("doc_id", "line_no", "line").join(hinted(gone, gone.count()), ["doc_id", "line_no"], "left_anti")


def _breaks(numbered: DataFrame) -> DataFrame:
    """Adds span (lines that a merge beginning here takes in, null if none can) and joined (the merged line) to lines with n1 to n4, the lines after each."""
    line = F.col("line")
    s = strip(line)
    # a sentence ends in one of a few characters before white space: SENTENCE_END, without a search
    opens = (s != "") & ~line.rlike(HEADING) & ~s.startswith(">") & ~s.startswith("<!--") & ~F.right(s, F.lit(1)).isin(*ENDS)
    n2 = strip(F.col("n2"))
    five = n2.rlike(PAGE_MARKER) & is_blank(F.col("n3")) & ~is_blank(F.col("n4")) & ~F.col("n4").rlike(HEADING)
    three = (n2 != "") & ~F.col("n2").rlike(HEADING) & n2.rlike(CONTINUES)
    cut = F.coalesce(is_blank(F.col("n1")) & opens, F.lit(False))
    spanned = numbered.withColumn("span", F.when(cut, F.when(F.coalesce(five, F.lit(False)), 4).when(F.coalesce(three, F.lit(False)), 2)))
    a, b = rstrip(line), lstrip(F.when(F.col("span") == 4, F.col("n4")).otherwise(F.col("n2")))
    joined = F.when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), b)).when(F.col("span") == 4, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    return spanned.withColumn("joined", F.when(F.col("span").isNotNull(), joined))


def _ahead(w: WindowSpec) -> list[Column]:
    return [F.lead("line", k).over(w).alias(f"n{k}") for k in range(1, 5)]


def merge_page_breaks(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """One line of a paragraph that a page break cut in two; a word's hyphen at the cut goes.

    A + blank + B where A doesn't end a sentence and B goes on in small letters, or A + blank + page mark + blank + B. Merges that
    would begin where another one ends are taken in turn: of a chain, the odd ones. The merged line has A's number.

    Documents with line numbers of ``block`` and more are worked on in blocks, so that no task sorts one whole.
    """
    lines = save(lines.select("doc_id", "line_no", "line"))
    huge = lines.groupBy("doc_id").agg(F.max("line_no").alias("n")).where(F.col("n") >= block).select("doc_id")
    huge = save(huge)
    if huge.isEmpty():
        return _merge_by_document(lines)
    known = hinted(huge, huge.count())
    return _merge_by_document(lines.join(known, "doc_id", "left_anti")).unionByName(_merge_by_block(lines.join(known, "doc_id", "left_semi"), block))


def _merge_by_document(lines: DataFrame) -> DataFrame:
    marked = _breaks(lines.select("doc_id", "line_no", "line", F.row_number().over(_by_line()).alias("i"), *_ahead(_by_line())))
    # a candidate continues a chain if it begins at the end of the nearest candidate before it
    before, so_far = _by_line().rowsBetween(Window.unboundedPreceding, -1), _by_line().rowsBetween(Window.unboundedPreceding, 0)
    can = F.col("span").isNotNull()
    ends = F.last(F.when(can, F.col("i") + F.col("span")), True).over(before)
    placed = marked.withColumns({"begins": can & ~ends.eqNullSafe(F.col("i")), "c": F.count(F.col("span")).over(so_far)})
    # its place in the chain: candidates so far, less those before the chain's first; all windows go by line, so lines are sorted once
    place = F.col("c") - F.last(F.when(F.col("begins"), F.col("c")), True).over(so_far) + 1
    taken = placed.withColumn("merge", can & (place % 2 == 1))
    covered = F.last(F.when(F.col("merge"), F.col("i") + F.col("span")), True).over(before)
    kept = taken.withColumn("covered", covered).where("merge OR covered IS NULL OR i > covered")
    return kept.select("doc_id", "line_no", F.when(F.col("merge"), F.col("joined")).otherwise(F.col("line")).alias("line"))


def _merge_by_block(lines: DataFrame, block: int) -> DataFrame:
    """The same; a block also sees the first four lines of the next one. Chains run over candidates alone, two numbers each."""
    part = F.floor((F.col("i") - 1) / block)
    seen = counted(lines.select("doc_id", "line_no", "line"), F.lit(True), "i", block=block).withColumn("own", part)
    edge = ((F.col("i") - 1) % block < 4) & (F.col("own") > 0)
    shown = seen.withColumn("part", F.explode(F.when(edge, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    w = Window.partitionBy("doc_id", "part").orderBy("i")
    marked = save(_breaks(shown.select("doc_id", "line_no", "line", "i", "own", "part", *_ahead(w))).where("own = part").select("doc_id", "line_no", "line", "i", "span", "joined"))
    by_place = Window.partitionBy("doc_id").orderBy("i")
    chained = marked.where("span IS NOT NULL").select("doc_id", "i", "span", (~F.lag(F.col("i") + F.col("span")).over(by_place).eqNullSafe(F.col("i"))).cast("int").alias("begins"))
    chained = chained.withColumn("chain", F.sum("begins").over(by_place))
    odd = chained.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("i"))).where("place % 2 = 1")
    taken = odd.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("span"))).alias("k"), "i").select("doc_id", (F.col("i") + F.col("k")).alias("i"), (F.col("k") == 0).alias("merge"))
    kept = marked.join(taken, ["doc_id", "i"], "left").where("merge IS NULL OR merge")
    return kept.select("doc_id", "line_no", F.when(F.col("merge"), F.col("joined")).otherwise(F.col("line")).alias("line"))


def clean(lines: DataFrame) -> DataFrame:
    """The whole job."""
    merged = merge_page_breaks(lines).select("doc_id", "line_no", soft_hyphen(F.col("line")).alias("line"), _title().alias("t"), _is_text(F.col("line")).alias("text"))
    # dropped lines stay where their titles count
    kept = merged.withColumn("kept", F.coalesce(F.col("text") & ~_is_typeset(F.col("line")), F.lit(False))).where("kept OR t IS NOT NULL")
    short = save(strip_inline_math(restore_latex_simple(kept)).select("doc_id", "line_no", "line", "t", "kept"))
    return _without_later(short.where("kept"), short.select("doc_id", "t"))


def mark_footnotes(lines: DataFrame) -> DataFrame:
    """A marker line before each note paragraph: one that follows a blank line and starts with a number and capital, or a short form.

    Markers are numbered by document; their line_no is that of the note, with ``ord`` 0 before 1.
    """
    line = F.col("line")
    after_blank = is_blank(F.lag("line", 1, "").over(_by_line()))
    note = (after_blank & line.rlike(r"^\d{1,3}(?U)\s+\p{Lu}")) | line.rlike(FOOTNOTE_SHORT)
    flagged = lines.withColumn("note", note)
    n = F.sum(F.col("note").cast("int")).over(_by_line())
    marked = flagged.withColumn("n", n)
    rows = F.when(F.col("note"), F.array(F.struct(F.lit(0).alias("ord"), F.concat(F.lit("<!-- footnote "), F.col("n"), F.lit(" -->")).alias("line")), F.struct(F.lit(1).alias("ord"), line.alias("line")))).otherwise(F.array(F.struct(F.lit(1).alias("ord"), line.alias("line"))))
    return marked.select("doc_id", "line_no", F.explode(rows).alias("r")).select("doc_id", "line_no", "r.ord", "r.line")


def merge_around_footnotes(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, par_no, kind, text) with kind ``text`` or ``note``: a paragraph that a note cut in two is one again, the note after it.

    A doesn't end a sentence, B goes on in small letters or with a bracket. Chains are taken as in ``merge_page_breaks``.
    """
    w = Window.partitionBy("doc_id").orderBy("par_no")
    p = paragraphs.select("*", F.row_number().over(w).alias("i"), F.lead("kind", 1).over(w).alias("k1"), F.lead("kind", 2).over(w).alias("k2"), F.lead("text", 2).over(w).alias("t2"))
    can = (F.col("kind") == "text") & (F.col("k1") == "note") & (F.col("k2") == "text") & ~F.col("text").rlike(SENTENCE_END) & F.col("t2").rlike(r"^[a-z(]")
    p = p.withColumn("can", F.coalesce(can, F.lit(False)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.last(F.when(F.col("can"), F.col("i") + 2), True).over(before)
    p = p.withColumn("chain", F.sum(F.when(F.col("can"), (~ends.eqNullSafe(F.col("i"))).cast("int"))).over(w))
    place = F.sum(F.col("can").cast("int")).over(Window.partitionBy("doc_id", "chain").orderBy("i"))
    p = p.withColumn("merge", F.col("can") & (place % 2 == 1))
    gone = F.coalesce(F.lag("merge", 2).over(w), F.lit(False))
    return p.withColumn("gone", gone).where("NOT gone").select("doc_id", "par_no", "kind", F.when(F.col("merge"), F.concat(rstrip(F.col("text")), F.lit(" "), F.col("t2"))).otherwise(F.col("text")).alias("text"))


def merge_split_headings(lines: DataFrame) -> DataFrame:
    """doc_id, line_no (of the first), level, heading: headings with nothing but blank lines and page numbers between them as one."""
    line = F.col("line")
    real = lines.where(~is_blank(line) & ~line.rlike(PAGE_NUMBER)).withColumn("level", heading_level(line))
    opens = (F.col("level").isNotNull() & ~F.lag("level").over(_by_line()).eqNullSafe(F.col("level"))).cast("int")
    islands = real.withColumn("o", opens).withColumn("g", F.sum("o").over(_by_line())).where("level IS NOT NULL")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", heading_text(line).alias("t")))), lambda x: x["t"]), " ")
    return islands.groupBy("doc_id", "g").agg(F.min("line_no").alias("line_no"), F.first("level").alias("level"), joined.alias("heading")).drop("g")


def fix_heading_levels(lines: DataFrame, toc: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Headings at the level that toc (doc_id, title, level) gives them; lines equal to a boilerplate (phrase) are gone.

    Both tables are joined by equality; Spark broadcasts them when their size allows.
    """
    line = F.col("line")
    left = lines.join(boilerplate.select(F.lower("phrase").alias("p")), F.lower(strip(line)) == F.col("p"), "left_anti")
    titled = left.withColumn("title", heading_text(line)).join(toc.select("doc_id", "title", F.col("level").alias("to")), ["doc_id", "title"], "left")
    return titled.select("doc_id", "line_no", F.when(F.col("to").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("to")), F.lit(" "), F.col("title"))).otherwise(line).alias("line"))


def heading_gate(lines: DataFrame, toc: DataFrame, slack: int = 2) -> DataFrame:
    """doc_id, level, expected, actual, diff, passed: level 1 must agree, level 2 within ``slack``; others pass."""
    actual = lines.select("doc_id", heading_level(F.col("line")).alias("level")).where("level IS NOT NULL").groupBy("doc_id", "level").agg(F.count("*").alias("actual"))
    expected = toc.groupBy("doc_id", "level").agg(F.count("*").alias("expected"))
    both = expected.join(actual, ["doc_id", "level"], "full_outer").fillna(0, ["expected", "actual"]).withColumn("diff", F.col("actual") - F.col("expected"))
    return both.withColumn("passed", F.when(F.col("level") == 1, F.col("diff") == 0).when(F.col("level") == 2, F.abs("diff") <= slack).otherwise(True))
