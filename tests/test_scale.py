"""Blocks of huge documents, and tables that are dealt out once."""

from __future__ import annotations

import random
import tempfile

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireworks.functions import arrow, text
from quireworks.functions.carry import carried, counted
from quireworks.functions.lineage import save_bucketed
from quireworks.operators import clean, index, validate
from quireworks.plans import chunking
from quireworks.sources.documents import write_chunk_table


def made_lines(rng):
    """Two documents of 2,000 lines, one with gaps, and small ones."""
    out = []
    for d, n, step in ((1, 2000, 1), (2, 2000, 7), (3, 5, 1), (4, 1, 50), (None, 30, 1)):
        for k in range(n):
            kind = rng.random()
            out.append((d, 1 + k * step, f"[{k}]" if kind < 0.01 else f"## Part {k}" if kind < 0.02 else "" if kind < 0.3 else f"line {k}"))
    return out


@pytest.mark.parametrize("block", [1, 20, 333, 10**6])
def test_blocks_equal_whole_windows(spark, block):
    rng = random.Random(block)
    lines = spark.createDataFrame(made_lines(rng), "doc_id bigint, line_no int, line string").where("doc_id IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = F.when(F.col("line").startswith("["), F.col("line"))
    assert rows(carried(lines, marked, "v", block=block)) == rows(lines.withColumn("v", F.last(marked, True).over(w)))
    flag = F.col("line").startswith("##")
    assert rows(counted(lines, flag, "n", block=block)) == rows(lines.withColumn("n", F.sum(flag.cast("int")).over(w)))
    assert rows(validate.page_of_line(lines, block)) == rows(validate.page_of_line(lines))
    chapters = lines.where(flag).select("doc_id", "line_no", F.col("line").alias("heading"))
    chunks = lines.where("line_no % 13 = 0").select("doc_id", (F.col("line_no") / 13).cast("int").alias("chunk_no"), F.col("line_no").alias("start"), F.lit("own").alias("heading"))
    assert rows(index.map_chapters(chunks, chapters, block)) == rows(index.map_chapters(chunks, chapters))
    sized = lines.withColumn("units", F.length("line").cast("bigint"))
    assert rows(chunking.parse_sections(sized, block)) == rows(chunking.parse_sections(sized))


@pytest.mark.parametrize("block", [5, 64, 400])
def test_merges_by_block_equal_merges_by_document(spark, block):
    rng = random.Random(block)
    parts = ["", "", "an open line", "and it goes on", "which ends.", "[12]", "broken-", "# Heading", "> quoted", "Then more", "(so)"]
    made = [(d, k + 1, rng.choice(parts)) for d, n in ((1, 1500), (2, 700), (3, 30), (4, 3)) for k in range(n)]
    made += [(5, k + 1, "" if k % 2 else "goes on") for k in range(999)]  # a chain through all blocks
    lines = spark.createDataFrame(made, "doc_id bigint, line_no int, line string")
    whole = rows(clean.merge_page_breaks(lines))
    assert rows(clean.merge_page_breaks(lines, block)) == whole and len(whole) < len(made)


def test_windows_hold_no_whole_document(spark):
    """The largest group that a window sorts is a block, not a document."""
    lines = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 997 == 3, F.col("id")).alias("v"))
    plan = carried(lines, F.col("v"), "c", block=100)._jdf.queryExecution().executedPlan().toString()
    assert all("__qw_block" in line or "__qw_end" in line or "_we" in line and "max" in line for line in plan.splitlines() if "+- Window " in line)
    found = carried(lines, F.col("v"), "c", block=100)
    assert found.where("line_no = 9999").first()["c"] == 9973 and found.where("c IS NULL").count() == 3


def test_bucketed_tables_move_no_rows(spark):
    texts = spark.range(200).select((F.col("id") % 40).alias("doc_id"), F.floor(F.col("id") / 40).cast("int").alias("chunk_no"), F.concat(F.lit("text "), "id").alias("body"))
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = write_chunk_table(texts, "qw_test_chunks", f"{folder}/chunks", 8)
        described = save_bucketed(texts.where("chunk_no != 2").select("doc_id", "chunk_no"), "doc_id", 8, ("chunk_no",))
        assert rows(chunks) == rows(texts) and described.count() == 160
        w = Window.partitionBy("doc_id").orderBy("chunk_no")
        both = chunks.join(described.withColumnRenamed("chunk_no", "k"), "doc_id").groupBy("doc_id").count()
        numbered = chunks.withColumn("r", F.row_number().over(w))
        for df in (both, numbered):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert numbered.where("r = 5").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS qw_test_chunks")


def test_lines_meet_chunks_without_broadcast(spark):
    """A few chunks of many lines each: their line numbers are as many as the lines, so they go to no driver."""
    lines = spark.range(20_000).select((F.col("id") % 4).alias("doc_id"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
    chunks = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(1).alias("chunk_no"), F.lit(2).alias("start"), F.lit(4000).alias("end"))
    found = chunking.lines_in_chunks(lines, chunks)
    assert found.count() == 4 * 3999
    texts = chunking.chunk_text(lines, chunks)
    assert [len(r.body.split("\n")) for r in texts.collect()] == [3999] * 4
    for df in (found, texts):
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("job", [lambda p: arrow.html_footnotes(p), lambda p: arrow.html_to_markdown(p), lambda p: arrow.markdown_with_notes(p), lambda p: arrow.read_epub_spine(p.selectExpr("'x' AS path", "CAST(html AS BINARY) AS content"))])
def test_workers_hold_few_pages(spark, job):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    try:
        pages = spark.range(0, 1000, 1, 1).select(F.col("id").alias("page_id"), F.lit("<p>x</p>").alias("html"))
        job(pages).count()
        sizes = pages.mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]] for b in batches), "n bigint")
        assert sizes.agg(F.max("n")).first()[0] <= arrow.BATCH_PAGES
    finally:
        spark.conf.unset(name)


def test_documents_are_folded_in_many_tasks(spark):
    rows_ = spark.range(40).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    sections = rows_.select(F.col("id").alias("doc_id"), F.col("n").cast("int").alias("section_no"), F.lit(2).alias("level"), F.lit("h").alias("heading"), (F.col("n") * 10).cast("int").alias("start"), (F.col("n") * 10 + 9).cast("int").alias("end"), F.lit(200).cast("bigint").alias("units"), F.lit(False).alias("is_toc"), *(F.lit(k).cast("bigint").alias(c) for c, k in (("least", 150), ("most", 1200), ("forced", 2500))))
    planned = chunking.plan_chunks(sections)
    assert planned.count() == 120
    assert planned.select(F.spark_partition_id()).distinct().count() > 1


def test_lines_and_chunks_are_made_once(spark, monkeypatch):
    from conftest import DATA

    from quireworks import fixtures
    from quireworks.queries import QUERIES

    made, real = [], fixtures.fx_lines
    monkeypatch.setattr(fixtures, "fx_lines", lambda *a: made.append(1) or real(*a))
    for name in ("i5_index_gaps", "i7_pending"):
        made.clear()
        QUERIES[name](spark, str(DATA))
        assert len(made) == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _numbered_lines(spark, n=400):
    text = F.when(F.col("id") % 20 == 0, F.concat(F.lit("# Title "), F.col("id") % 3)).when(F.col("id") % 2 == 1, F.lit("")).otherwise(F.concat(F.lit("goes on "), "id"))
    return spark.range(n).select((F.col("id") % 4).alias("doc_id"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("line_no"), text.alias("line"))


def test_planning_moves_no_text(spark):
    """Lines are measured in one pass; the windows, joins and aggregates of planning go without their text, and a plan is made once."""
    lines = _numbered_lines(spark)
    sections = chunking.sections_of(lines)
    assert sections.count() > 0 and "line#" not in _plan(sections)
    plan = chunking.plan_documents(lines)
    assert plan.count() > 0 and "Exchange" not in _plan(plan)


def test_white_space_is_that_of_the_patterns(spark):
    points = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).where("c != ''")  # a byte order mark is none
    white = points.where(F.length(F.regexp_replace("c", text.SPACE, "")) == 0)
    assert {r.c for r in white.collect()} == set(text.WHITE)
    odd = ["", " ", "a", "  a\t", "　你 ", "a \x85", " b c ", "\x1c a", "a\n", "é  è 1"]
    df = spark.createDataFrame([(x,) for x in [*odd, None]], "c string")
    trimmed = df.select("c", F.regexp_replace("c", r"(?U)^\s+|\s+$", "").alias("want"), text.strip(F.col("c")).alias("got"))
    assert all(r.want == r.got for r in trimmed.collect())
    counts = df.select(F.length(F.regexp_replace("c", text.CJK_WIDE, "")).alias("want"), text.cjk_count(F.col("c")).alias("got"))
    assert all(r.want == r.got for r in counts.collect())


def test_measures_without_headings_and_numbers(spark):
    """A line's number at its end, in any digits, before white space or none; blank lines have no words."""
    made = ["Chapter one 12", " 7", "7", "x 7 ", "x7", "x ٣", "x 7.", "", "  ", "Part 二 3　", "a b  c"]
    lines = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(made)], "doc_id bigint, line_no int, line string")
    found = lines.join(chunking.line_measures(lines), ["doc_id", "line_no"])
    for r in found.withColumn("numbered", F.col("line").rlike(chunking.TRAILING_NUMBER)).collect():
        assert (r.entry is not None) == r.numbered, r
        assert r.words == len(r.line.split()) and r.visible == len("".join(r.line.split()))
    assert {r.line for r in found.where("entry").collect()} == {"Chapter one 12", "Part 二 3　"}


def test_lines_are_sorted_once_for_merges(spark):
    lines = _numbered_lines(spark)
    plan = _plan(clean._merge_by_document(lines))
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    # titles are ranked without the lines' text, which isn't shuffled by title
    assert "Window" not in _plan(clean.dedupe_h1(lines, lines))
    whole = clean.clean(lines)
    again = [r.line for r in whole.where("line LIKE '# %'").collect()]
    assert len(again) == len(whole.where("line LIKE '# %'").select("doc_id", "line").distinct().collect())


def test_sentence_ends_are_the_pattern(spark):
    lines = [f"a{x}{y}" for x in [*clean.ENDS, "b", ",", "-", "…"] for y in ("", " ", "　\t", "\x85", "\n", "b")]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    found = df.select(F.col("line").rlike(clean.SENTENCE_END).alias("want"), F.right(text.strip(F.col("line")), F.lit(1)).isin(*clean.ENDS).alias("got"))
    assert all(r.want == r.got for r in found.collect())


def test_headings_and_chapters_are_made_once(spark):
    """They are written down, as the steps after them read them four times."""
    from conftest import DATA

    from quireworks.queries import QUERIES

    lines = _numbered_lines(spark)
    chapters = lines.where("line LIKE '# Title 1%'").select("doc_id", "line_no", F.col("line").alias("heading"))
    chunks = lines.where("line_no % 13 = 0").select("doc_id", (F.col("line_no") / 13).cast("int").alias("chunk_no"), F.col("line_no").alias("start"), F.lit("own").alias("heading"))
    mapped = index.map_chapters(chunks, chapters)
    assert mapped.count() == chunks.count() and "Title 1" not in _plan(mapped)
    assert "RLIKE" not in _plan(QUERIES["i4_chapter_groups"](spark, str(DATA)))


def test_index_reads_the_books_that_it_cuts(spark, monkeypatch):
    from conftest import DATA

    from quireworks import fixtures
    from quireworks.queries import QUERIES, records

    made, real = [], fixtures.fx_lines
    for module in (fixtures, records):
        monkeypatch.setattr(module, "fx_lines", lambda *a: made.append(1) or real(*a))
    QUERIES["s8_render_index"](spark, str(DATA))
    assert len(made) == 1


def test_citations_of_documents_with_sections(spark):
    """Two sections, one that is empty, and none; only documents that have one go through a window."""
    texts = {1: ["# A", "x", "## 引用信息 ", " one ", "", "# B", "## end", "no", "## 引用信息", "two"], 2: ["no title", "## 引用信息", " "], 3: ["# ", "# C", "## other", "y"], None: ["# N", "## 引用信息", "n"]}
    lines = spark.createDataFrame([(d, k + 1, x) for d, t in texts.items() for k, x in enumerate(t)], "doc_id bigint, line_no int, line string")
    found = index.doc_meta(lines)
    assert rows(found) == [(1, "A", "one\n# B\ntwo"), (2, "未知文献", "[引用信息待补充]"), (3, "", "[引用信息待补充]"), (None, "N", "n")]
    assert "LeftSemi" in _plan(found)
