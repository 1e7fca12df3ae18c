"""The supplied tables dressed as books, drafts, plans, descriptions and records.

Each dressing is given twice: as DataFrames, and as SQL that DuckDB runs on the same tables. Jobs don't know of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.functions.lineage import save
from quireworks.plans.chunking import group_at_level, sections_of

#: The Chinese letters that stand for a to z in every fourth book.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丑专且世丘丙业丛东丝丞丢两严丧个"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos (from 0), t of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents as one Markdown book with headings, page and footnote marks, formulas and broken paragraphs."""
    src = raw_lines(spark, sf_dir).withColumn("book", F.col("doc_id") - F.col("doc_id") % 10)
    pos, t = F.col("pos"), F.col("t")
    u = F.when(F.col("book") % 40 == 0, F.translate(F.lower(t), LATIN, HAN)).otherwise(t)
    v = F.when(pos % 5 == 0, F.regexp_replace(u, "[.?!]+$", "")).when(pos % 5 == 1, F.lower(u)).otherwise(u)
    name = F.when((F.col("doc_id") % 10).isin(0, 9), F.concat(F.lit("# Book "), F.col("book").cast("string"))).when((F.col("doc_id") % 10).isin(1, 4, 7), F.concat(F.lit("## Part "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("### Sub "), F.col("doc_id").cast("string")))
    row = lambda at, k, line: F.struct(at.cast("int").alias("pos"), F.lit(k).alias("k"), line.alias("line"))
    mark, note = pos % 7 == 5, pos % 11 == 3
    rows = F.array(
        F.when(pos == 0, row(F.lit(-1), 0, name)), F.when(pos == 0, row(F.lit(-1), 1, F.lit(""))),
        row(pos, 0, F.when(pos % 13 == 0, F.concat(v, F.lit(r" $12\sim34$"))).otherwise(v)), row(pos, 1, F.lit("")),
        F.when(mark, row(pos, 2, F.concat(F.lit("["), (F.col("doc_id") % 500 + pos).cast("string"), F.lit("]")))), F.when(mark, row(pos, 3, F.lit(""))),
        F.when(note, row(pos, 4, F.concat(F.lit("<!-- footnote "), pos.cast("string"), F.lit(" -->")))), F.when(note, row(pos, 5, F.concat(pos.cast("string"), F.lit(" "), F.substring(t, 1, 40)))), F.when(note, row(pos, 6, F.lit(""))),
    )
    parts = src.select("doc_id", "book", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"))
    number = F.row_number().over(Window.partitionBy("book").orderBy("doc_id", "r.pos", "r.k"))
    return parts.select(F.col("book").alias("doc_id"), number.cast("int").alias("line_no"), F.col("r.line").alias("line"))


def fx_sections(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Lines are written down, as they are read twice."""
    return sections_of(save(fx_lines(spark, sf_dir)) if lines is None else lines)


def fx_chunks(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """A plan: each unit at level 2 is a chunk. Written down, as jobs use it more than once."""
    return save(group_at_level(fx_sections(spark, sf_dir, lines)).select("doc_id", F.col("unit_no").alias("chunk_no"), "start", "end", "heading", "units"))


def fx_book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and their chunks, both written down."""
    lines = save(fx_lines(spark, sf_dir))
    return lines, fx_chunks(spark, sf_dir, lines)


def fx_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thesis a conversation: thesis_id, file, line_no, line."""
    c, t = F.col("conv_id"), F.col("turn")
    key = lambda x: F.concat(F.lit("[^k"), (x % 9).cast("string"), F.lit("]"))
    line1 = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), key(c * 7 + t * 3), F.lit(" and "), key(c + t))
    line2 = F.when((c + t) % 9 < 8, F.concat(key((c + t) % 5), F.lit(": def "), ((c + t) % 9 + 100 * (t % 2)).cast("string")))
    rows = table(spark, sf_dir, "conversations").select(c.alias("thesis_id"), F.when(t == 0, "introduction").otherwise(F.concat(F.lit("chapter"), t.cast("string"))).alias("file"), F.posexplode(F.array(line1, line2)).alias("p", "line"))
    return rows.where("line IS NOT NULL").select("thesis_id", "file", (F.col("p") + 1).cast("int").alias("line_no"), "line")


def fx_description_lines(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    """doc_id, part, line_no, line: one chunk in five isn't described, one in seven described twice, one in eleven is unknown."""
    chunks = fx_chunks(spark, sf_dir) if chunks is None else chunks
    n, h = F.col("chunk_no"), F.col("heading")
    block = lambda number, text: F.array(F.concat(F.lit("chunk-"), number.cast("string"), F.lit(".md: "), text), F.concat(F.lit("  about "), h), F.concat(F.lit("  size "), (F.col("units") % 50).cast("string")), F.concat(F.lit("  Tags: tag"), (F.col("doc_id") % 7).cast("string"), F.lit(", tag"), (number % 3).cast("string"), F.lit(", book")))
    first = chunks.where(n % 5 != 0).select("doc_id", F.lit("a").alias("part"), n.alias("n"), F.posexplode(block(n, h)).alias("p", "line"))
    again = chunks.where(n % 7 == 0).select("doc_id", F.lit("b").alias("part"), n.alias("n"), F.posexplode(block(n, F.concat(F.lit("again "), h))).alias("p", "line"))
    extra = chunks.where(n % 11 == 1).select("doc_id", F.lit("c").alias("part"), (n + 1000).alias("n"), F.posexplode(block(n + 1000, h)).alias("p", "line"))
    return first.unionByName(again).unionByName(extra).select("doc_id", "part", (F.col("n") * 4 + F.col("p") + 1).cast("int").alias("line_no"), "line")


def fx_bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents: the title is a text's beginning, one DOI in three is missing, one in two has its address."""
    i = F.col("doc_id")
    provider = F.element_at(F.array(*map(F.lit, ("semantic_scholar", "crossref", "openalex", "unpaywall"))), (i % 4 + 1).cast("int"))
    doi = F.when(i % 3 != 0, F.concat(F.when(i % 2 == 0, "https://doi.org/").otherwise(""), F.lit("10.1/"), (F.floor(i / 4)).cast("string")))
    authors = F.array(F.concat(F.lit("Author "), (i % 17).cast("string")), F.concat(F.lit("Author "), (i % 5).cast("string")))
    return table(spark, sf_dir, "documents").select(i.alias("record_id"), provider.alias("provider"), F.substring("text", 1, 60).alias("title"), authors.alias("authors"), (F.lit(1990) + i % 30).cast("int").alias("year"), doi.alias("doi"), F.when(i % 5 != 0, (i * 7) % 101).alias("citations"), F.when(i % 4 != 1, F.concat(F.lit("https://x.example/"), i.cast("string"))).alias("oa_url"), F.concat(F.lit("Venue "), (i % 9).cast("string")).alias("venue"), F.when(i % 2 == 0, "book").otherwise("paper").alias("type"))


def fx_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each turn: fields empty and references dangling by number."""
    c, t = F.col("conv_id"), F.col("turn")
    path = lambda n: F.struct(F.concat(F.lit("chunk-"), n.cast("string")).alias("path"), F.lit("").alias("note"))
    refs = F.when(t % 4 == 3, F.array().cast("array<struct<path:string,note:string>>")).otherwise(F.array(path((c * 3 + t) % 40), path((c + t) % 25)))
    return table(spark, sf_dir, "conversations").select(c.alias("thesis_id"), t.cast("int").alias("chapter"), t.alias("ord"), t.cast("string").alias("section_no"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.when(c % 3 != 0, F.col("text")).alias("claim"), F.when(t % 3 != 1, F.substring("text", 5, 1 << 30)).otherwise(" ").alias("reasoning"), F.lit("plain").alias("style"), refs.alias("refs"))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


LINES_SQL = rf"""
src AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) a FROM documents)),
base AS (SELECT doc_id, CAST(doc_id - doc_id % 10 AS BIGINT) AS book, pos, t FROM src),
txt AS (SELECT *, CASE WHEN book % 40 = 0 THEN translate(lower(t), '{LATIN}', '{HAN}') ELSE t END AS u FROM base),
brk AS (SELECT *, CASE WHEN pos % 5 = 0 THEN regexp_replace(u, '[.?!]+$', '') WHEN pos % 5 = 1 THEN lower(u) ELSE u END AS v FROM txt),
heads AS (SELECT DISTINCT doc_id, book FROM brk),
parts AS (
  SELECT doc_id, book, -1 AS pos, 0 AS k, CASE WHEN doc_id % 10 IN (0, 9) THEN '# Book ' || CAST(book AS VARCHAR) WHEN doc_id % 10 IN (1, 4, 7) THEN '## Part ' || CAST(doc_id AS VARCHAR) ELSE '### Sub ' || CAST(doc_id AS VARCHAR) END AS line FROM heads
  UNION ALL SELECT doc_id, book, -1, 1, '' FROM heads
  UNION ALL SELECT doc_id, book, pos, 0, CASE WHEN pos % 13 = 0 THEN v || ' $12\sim34$' ELSE v END FROM brk
  UNION ALL SELECT doc_id, book, pos, 1, '' FROM brk
  UNION ALL SELECT doc_id, book, pos, 2, '[' || CAST(doc_id % 500 + pos AS VARCHAR) || ']' FROM brk WHERE pos % 7 = 5
  UNION ALL SELECT doc_id, book, pos, 3, '' FROM brk WHERE pos % 7 = 5
  UNION ALL SELECT doc_id, book, pos, 4, '<!-- footnote ' || CAST(pos AS VARCHAR) || ' -->' FROM brk WHERE pos % 11 = 3
  UNION ALL SELECT doc_id, book, pos, 5, CAST(pos AS VARCHAR) || ' ' || substr(t, 1, 40) FROM brk WHERE pos % 11 = 3
  UNION ALL SELECT doc_id, book, pos, 6, '' FROM brk WHERE pos % 11 = 3),
fx_lines AS (SELECT book AS doc_id, CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id, pos, k) AS INT) AS line_no, line FROM parts),
hl AS (SELECT *, CAST(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN length(regexp_extract(line, '^(#+)', 1)) END AS INT) AS level,
         CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN trim(regexp_replace(line, '^#+\s+', '')) END AS heading,
         length(regexp_replace(line, '[^\x{{3000}}-\x{{303f}}\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS cjk,
         len([x FOR x IN string_split_regex(line, '\s+') IF x != '']) AS words FROM fx_lines)
"""

SECTIONS_SQL = (
    LINES_SQL
    + r""",
lang AS (SELECT doc_id, CASE WHEN sum(length(regexp_replace(line, '\s', '', 'g'))) > 0 AND sum(length(regexp_replace(line, '[^\x{4e00}-\x{9fff}]', '', 'g'))) > 0.2 * sum(length(regexp_replace(line, '\s', '', 'g'))) THEN 'zh' ELSE 'en' END AS language
         FROM fx_lines WHERE line_no <= 500 GROUP BY doc_id),
ul AS (SELECT hl.*, language, CASE WHEN language = 'zh' THEN cjk ELSE words END AS units FROM hl JOIN lang USING (doc_id)),
numbered AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM ul),
raw_sections AS (SELECT doc_id, CAST(s AS INT) AS section_no, max(level) AS level, max(heading) AS heading, min(line_no) AS start, max(line_no) AS "end", CAST(sum(units) AS BIGINT) AS units,
           count(*) FILTER (trim(line) != '') AS n, sum(words) AS w, count(*) FILTER (regexp_matches(line, '\s+\d+\s*$')) AS e,
           count(*) FILTER (regexp_matches(line, '\s+\d+\s*$') AND regexp_matches(trim(line), '(?i)^(chapter|appendix|part|book)\s+')) AS c
         FROM numbered WHERE s > 0 GROUP BY doc_id, s),
sections AS (SELECT doc_id, section_no, level, heading, start, "end", units, contains(lower(heading), 'contents') OR (e >= 0.6 * n AND w < 18 * n AND w <= 600) OR (c >= 3 AND w <= 400) AS is_toc FROM raw_sections),
in_units AS (SELECT *, sum(CASE WHEN level <= 2 OR section_no = first_no THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section_no) AS unit_no FROM (SELECT *, min(section_no) OVER (PARTITION BY doc_id) AS first_no FROM sections)),
units AS (SELECT doc_id, CAST(unit_no AS INT) AS unit_no, min(section_no) AS first_section, max(section_no) AS last_section, min(level) AS level,
            coalesce(arg_min(heading, section_no) FILTER (level <= 2), arg_min(heading, section_no)) AS heading, min(start) AS start, max("end") AS "end", CAST(sum(units) AS BIGINT) AS units
          FROM in_units GROUP BY doc_id, unit_no),
fx_chunks AS (SELECT doc_id, unit_no AS chunk_no, start, "end", heading, units FROM units)
"""
)

DRAFTS_SQL = """
turns AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'introduction' ELSE 'chapter' || CAST(turn AS VARCHAR) END AS file,
   replace(text, chr(10), ' ') || '[^k' || CAST((conv_id * 7 + turn * 3) % 9 AS VARCHAR) || '] and [^k' || CAST((conv_id + turn) % 9 AS VARCHAR) || ']' AS line1,
   CASE WHEN (conv_id + turn) % 9 < 8 THEN '[^k' || CAST((conv_id + turn) % 5 AS VARCHAR) || ']: def ' || CAST((conv_id + turn) % 9 + 100 * (turn % 2) AS VARCHAR) END AS line2 FROM conversations),
fx_drafts AS (SELECT conv_id AS thesis_id, file, 1 AS line_no, line1 AS line FROM turns UNION ALL SELECT conv_id, file, 2, line2 FROM turns WHERE line2 IS NOT NULL),
files AS (SELECT DISTINCT thesis_id, file FROM fx_drafts),
ranked AS (SELECT *, CASE WHEN file = 'introduction' THEN 0 WHEN file = 'conclusion' THEN 9 WHEN regexp_matches(file, '^chapter[1-8]$') THEN CAST(substr(file, 8) AS INT) WHEN starts_with(file, 'chapter') THEN 10 END AS rank FROM files),
file_order AS (SELECT thesis_id, file, CAST(row_number() OVER (PARTITION BY thesis_id ORDER BY rank, file) AS INT) AS file_ord FROM ranked WHERE rank IS NOT NULL),
ol AS (SELECT thesis_id, file, line_no, line, file_ord FROM fx_drafts JOIN file_order USING (thesis_id, file)),
cites AS (SELECT thesis_id, file_ord, line_no, CAST(generate_subscripts(k, 1) - 1 AS INT) AS pos, unnest(k) AS key FROM (SELECT *, regexp_extract_all(line, '\\[\\^([^\\]]+)\\]', 1) AS k FROM ol WHERE NOT regexp_matches(line, '^\\[\\^[^\\]]+\\]:'))),
defs AS (SELECT thesis_id, file_ord, line_no, regexp_extract(line, '^\\[\\^([^\\]]+)\\]:', 1) AS key, trim(regexp_replace(line, '^\\[\\^[^\\]]+\\]:', '')) AS defn FROM ol WHERE regexp_matches(line, '^\\[\\^[^\\]]+\\]:')),
numbers AS (SELECT thesis_id, key, CAST(row_number() OVER (PARTITION BY thesis_id ORDER BY f) AS INT) AS number FROM (SELECT thesis_id, key, min(file_ord * 1000000 + line_no * 1000 + pos) AS f FROM cites GROUP BY thesis_id, key))
""".replace("\\\\", "\\")

BIB_SQL = """
bib AS (SELECT doc_id AS record_id, ['semantic_scholar', 'crossref', 'openalex', 'unpaywall'][CAST(doc_id % 4 + 1 AS INT)] AS provider, substr(text, 1, 60) AS title,
   ['Author ' || CAST(doc_id % 17 AS VARCHAR), 'Author ' || CAST(doc_id % 5 AS VARCHAR)] AS authors, CAST(1990 + doc_id % 30 AS INT) AS year,
   CASE WHEN doc_id % 3 != 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/' ELSE '' END || '10.1/' || CAST(doc_id // 4 AS VARCHAR) END AS doi,
   CASE WHEN doc_id % 5 != 0 THEN (doc_id * 7) % 101 END AS citations, CASE WHEN doc_id % 4 != 1 THEN 'https://x.example/' || CAST(doc_id AS VARCHAR) END AS oa_url,
   'Venue ' || CAST(doc_id % 9 AS VARCHAR) AS venue, CASE WHEN doc_id % 2 = 0 THEN 'book' ELSE 'paper' END AS type FROM documents),
bd AS (SELECT *, CASE WHEN doi IS NOT NULL THEN lower(replace(doi, 'https://doi.org/', '')) END AS d FROM bib)
"""

OUTLINE_SQL = """
outline AS (SELECT conv_id AS thesis_id, turn AS ord, CAST(turn AS VARCHAR) AS section_no, CASE WHEN conv_id % 3 != 0 THEN text END AS claim,
   CASE WHEN turn % 3 != 1 THEN substr(text, 5) ELSE ' ' END AS reasoning, 'plain' AS style,
   CASE WHEN turn % 4 = 3 THEN [] ELSE ['chunk-' || CAST((conv_id * 3 + turn) % 40 AS VARCHAR), 'chunk-' || CAST((conv_id + turn) % 25 AS VARCHAR)] END AS refs FROM conversations),
orefs AS (SELECT thesis_id, section_no, unnest(refs) AS path FROM outline),
known AS (SELECT DISTINCT 'chunk-' || CAST(doc_id % 30 AS VARCHAR) AS path FROM documents)
"""
