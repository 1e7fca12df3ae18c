"""Queries over lines: sources, cleaning, measures, planning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.fixtures import LINES_SQL, SECTIONS_SQL, fx_book, fx_chunks, fx_lines, fx_sections, raw_lines, table
from quireworks.functions.lineage import save, shared_dir
from quireworks.functions.text import cjk_count, heading_level, word_count
from quireworks.operators import clean, extract
from quireworks.operators.index import headings_of
from quireworks.plans import chunking
from quireworks.queries.registry import Registry
from quireworks.sources.documents import parse_plan, scan_inbox, to_lines, write_chunk_table, write_chunks
from quireworks.streaming.inbox import ingest_stream
from quireworks.streaming.sync import ChunkTable

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _flat(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), "|").alias(c)


@query("""WITH d AS (SELECT coalesce(source, '') AS doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, ['markdown', 'html', 'pdf-unsupported', 'unknown'][length(doc_id) % 4 + 1] AS route, CAST(sum(strlen(text) + 1) AS BIGINT) AS length FROM d GROUP BY doc_id""")
def s1_scan_inbox(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each source written as files of an inbox, some 64 for a source at most, which is scanned; sizes are summed by
    source. Files are named by the source in hexadecimal digits, so any source will do."""
    inbox = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    source = F.coalesce("source", F.lit(""))
    extension = F.element_at(F.array(*map(F.lit, ("md", "html", "pdf", "bin"))), (F.length(source) % 4 + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("-", F.lit("s"), F.hex(source), extension).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("kind", F.pmod(F.xxhash64("doc_id"), F.lit(64))).select("kind", "text").write.partitionBy("kind").text(inbox)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(inbox).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, file in enumerate(fs.globStatus(place(f"{inbox}/kind=*/part-*"))):
        _, name, ending = file.getPath().getParent().getName().split("-")
        fs.rename(file.getPath(), place(f"{inbox}/{name}~{n}.{ending}"))
    name = F.decode(F.unhex(F.substring_index("doc_id", "~", 1)), "UTF-8")
    return scan_inbox(spark, inbox).groupBy(name.alias("doc_id"), "route").agg(F.sum("length").alias("length"))


@query("""SELECT doc_id, CAST(generate_subscripts(a, 1) AS INT) AS line_no, unnest(a) AS line FROM (
  SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM documents WHERE text IS NOT NULL)""")
def s2_to_lines(spark: SparkSession, sf: str) -> DataFrame:
    return to_lines(table(spark, sf, "documents"))


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, CAST(chunk_no AS VARCHAR) || CASE WHEN chunk_no % 4 = 0 THEN 'b' ELSE '' END AS raw_id, start, \"end\", units, heading, CASE WHEN chunk_no % 3 = 0 THEN 'under-size|check' ELSE '' END AS warnings FROM fx_chunks WHERE chunk_no % 5 != 0")
def s6_parse_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Plans written as text, contents rows among them, and read back."""
    n = F.col("chunk_no")
    name = F.when(n % 5 == 0, F.concat(F.lit("toc-"), n.cast("string"))).otherwise(F.concat(F.lit("chunk-"), n.cast("string"), F.when(n % 4 == 0, "b").otherwise("")))
    row = F.concat(name, F.lit(" [行"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(", ~"), F.col("units").cast("string"), F.lit("字] # "), "heading", F.when(n % 3 == 0, " | under-size | check").otherwise(""))
    return parse_plan(fx_chunks(spark, sf).select("doc_id", row.alias("line"))).withColumn("warnings", _flat("warnings"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)[ \t\r\f\v]+$', '', 'g'), '\n{4,}', E'\n\n\n', 'g') AS text FROM (SELECT doc_id, replace(replace(text, 'the', 'the  ' || chr(10) || chr(10)), 'of', chr(10) || chr(10) || chr(10) || 'of') AS t FROM documents)""")
def e10_normalise_blank(spark: SparkSession, sf: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("the"), F.lit("the  \n\n")), F.lit("of"), F.lit("\n\n\nof"))
    return extract.normalise_blank(table(spark, sf, "documents").select("doc_id", text.alias("text")))


@query(f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (level = 2) AS h2, count(*) FILTER (level = 3) AS h3, count(*) FILTER (level = 4) AS h4,
  count(*) FILTER (starts_with(line, '<!-- footnote ')) AS footnotes FROM hl GROUP BY doc_id""")
def e11_extract_stats(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_stats(fx_lines(spark, sf))


_NOISY = "CASE WHEN line_no % 19 = 0 THEN '![image](https://cdn.example/' || CAST(line_no AS VARCHAR) WHEN line_no % 23 = 0 THEN 'c h a p t e r 1' ELSE line END"


def _noisy(lines: DataFrame) -> DataFrame:
    n = F.col("line_no")
    return lines.withColumn("line", F.when(n % 19 == 0, F.concat(F.lit("![image](https://cdn.example/"), n.cast("string"))).when(n % 23 == 0, "c h a p t e r 1").otherwise(F.col("line")))


@query(rf"""WITH {LINES_SQL}, noisy AS (SELECT doc_id, line_no, {_NOISY} AS line FROM fx_lines)
SELECT * FROM noisy WHERE NOT starts_with(line, '![image](http') AND NOT regexp_matches(line, '^\s*(\d+|\[\d+\])\s*$') AND NOT regexp_matches(line, '^[A-Za-z](?:\s+[A-Za-z0-9])+\s*$')""")
def c1_c3_drop_noise(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_noise_lines(_noisy(fx_lines(spark, sf)))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_replace(replace(line, 'th', 'tÂ h'), '([A-Za-z])Â\\s*([A-Za-z])', '\\1\\2', 'g') AS line FROM fx_lines")
def c4_soft_hyphen(spark: SparkSession, sf: str) -> DataFrame:
    return clean.repair_soft_hyphen(fx_lines(spark, sf).withColumn("line", F.replace("line", F.lit("th"), F.lit("tÂ h"))))


@query(rf"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_no, CASE WHEN line_no % 17 = 0 THEN '$\mathrm{{x}}$ ' || substr(line, 1, line_no % 20) ELSE line END AS line FROM fx_lines)
SELECT * FROM t WHERE NOT (regexp_matches(line, '\$[^$]*\\(?:mathrm|times|mathbf|text|rm|bf|it|tt|sf|sc)[^$]*\$') AND length(trim(regexp_replace(line, '\$[^$]{{1,120}}\$', '', 'g'))) < 10)""")
def c5_drop_typeset(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    return clean.drop_typeset(fx_lines(spark, sf).withColumn("line", F.when(n % 17 == 0, F.concat(F.lit(r"$\mathrm{x}$ "), F.substring("line", F.lit(1), n % 20))).otherwise(F.col("line"))))


_MATH = "CASE WHEN line_no % 9 = 0 THEN line || ' $12-15$ and $[3]$ $7$ $①$' ELSE line END"


@query(rf"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_no, {_MATH} AS line FROM fx_lines),
a AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '^\[\s*\$\s*([①-⑩\d]+)\s*\$', '\1'), '\$\s*([①②③④⑤⑥⑦⑧⑨⑩])\s*\$', '\1', 'g'), '\$\[(\d+)\]\$', '[\1]', 'g') AS line FROM t)
SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '\$\[?(\d+)\\sim(\d+)\]?\$(?:\s*\$\[?\d+\\sim\d+\]?\$)?', '\1–\2', 'g'), '\$(\d+)-(\d+)\$', '\1–\2', 'g'), '\$(\d+)\$', '\1', 'g') AS line FROM a""")
def c6_restore_latex(spark: SparkSession, sf: str) -> DataFrame:
    n, line = F.col("line_no"), F.col("line")
    return clean.restore_latex_simple(fx_lines(spark, sf).withColumn("line", F.when(n % 9 == 0, F.concat(line, F.lit(" $12-15$ and $[3]$ $7$ $①$"))).otherwise(line)))


#: Formulas, with two digits of a line's number in place of 8 and 9, and what they are as text.
FORMULAS = [
    (r"$ \mathrm { A } _ { 8 9 } $", "A 89"), (r"$8 9 - 9 8$", "89–98"), (r"$\S 8 9$", "§ 89"), (r"$8 0 ^ { \circ } \mathrm { C }$", "80 ° C"), (r"$\alpha + 8$", r"$\alpha + 8$"), (r"$\alpha \times 9$", ""),
    (r"$\left( \mathbf { a } x \right)$", "( a x )"), (r"$\hspace { 8 m m } k ~ 9$", "k 9"), (r"${ \rm { v i } } \quad { . } 8$", "{ v i } . 8"), (r"$\operatorname { p q } _ { \textit { r } } \, 9$", "p q r 9"), (r"$\frac { 8 } { 9 }$", r"$\frac { 8 } { 9 }$"),
]


def _formula_sql(which: int, k: str) -> str:
    texts = ", ".join("'" + pair[which] + "'" for pair in FORMULAS)
    return f"replace(replace([{texts}][CAST({k} % {len(FORMULAS)} + 1 AS INT)], '8', CAST(({k} + 1) % 8 AS VARCHAR)), '9', CAST({k} % 7 AS VARCHAR))"


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, {_formula_sql(1, 'line_no')} || ' ' || replace(line, '$', 'S') || ' ' || {_formula_sql(1, '(doc_id + line_no)')} AS line FROM fx_lines")
def c7_strip_inline_math(spark: SparkSession, sf: str) -> DataFrame:
    """Lines between formulas whose text is known."""

    def made(k: Column) -> Column:
        pick = F.element_at(F.array(*(F.lit(f) for f, _ in FORMULAS)), (k % len(FORMULAS) + 1).cast("int"))
        return F.replace(F.replace(pick, F.lit("8"), ((k + 1) % 8).cast("string")), F.lit("9"), (k % 7).cast("string"))

    n = F.col("line_no").cast("bigint")
    line = F.concat_ws(" ", made(n), F.replace("line", F.lit("$"), F.lit("S")), made(F.col("doc_id") + n))
    return clean.strip_inline_math(fx_lines(spark, sf).withColumn("line", line))


@query(f"""WITH {LINES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, heading ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id, heading) AS n FROM hl WHERE level = 1)
SELECT doc_id, line_no, line FROM hl WHERE level IS NULL OR level != 1 UNION ALL SELECT doc_id, line_no, line FROM t WHERE n = 1 OR r = 1""")
def c8_dedupe_h1(spark: SparkSession, sf: str) -> DataFrame:
    lines = save(fx_lines(spark, sf))
    return clean.dedupe_h1(lines, lines)


_END, _GO = r"[.?!;:\"''\)\]）」』。？！；：”]\s*$", "^[a-z,;(‘“\"'']"


def _merged_sql(source: str) -> str:
    """merged: the lines of ``source`` after page-break merges, walked from the first line on."""
    return rf"""
n AS (SELECT doc_id, line_no, line, lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2, lead(line, 3) OVER w AS n3, lead(line, 4) OVER w AS n4 FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
o AS (SELECT *, trim(line) != '' AND NOT regexp_matches(line, '^#{{1,6}}\s+.+$') AND NOT starts_with(trim(line), '>') AND NOT starts_with(trim(line), '<!--') AND NOT regexp_matches(line, '{_END}') AND trim(n1) = '' AS opens FROM n),
c AS (SELECT *, CASE WHEN opens AND regexp_matches(trim(n2), '^\[\d+\]\s*$') AND trim(n3) = '' AND trim(n4) != '' AND NOT regexp_matches(n4, '^#{{1,6}}\s+.+$') THEN 4
      WHEN opens AND trim(n2) != '' AND NOT regexp_matches(n2, '^#{{1,6}}\s+.+$') AND regexp_matches(trim(n2), '{_GO}') THEN 2 ELSE 0 END AS span FROM o),
walk AS (SELECT doc_id, line_no, span FROM c WHERE line_no = 1
   UNION ALL SELECT c.doc_id, c.line_no, c.span FROM walk JOIN c ON c.doc_id = walk.doc_id AND c.line_no = walk.line_no + walk.span + 1),
merged AS (SELECT doc_id, line_no, CASE WHEN c.span = 0 THEN line ELSE CASE WHEN ends_with(rtrim(line), '-') THEN rtrim(line)[:-2] || ltrim(CASE c.span WHEN 4 THEN n4 ELSE n2 END) WHEN c.span = 4 THEN rtrim(line) || ltrim(n4) ELSE rtrim(line) || ' ' || ltrim(n2) END END AS line
FROM walk JOIN c USING (doc_id, line_no))"""


@query(f"WITH RECURSIVE {LINES_SQL}, {_merged_sql('fx_lines')} SELECT * FROM merged")
def c9_merge_page_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return clean.merge_page_breaks(fx_lines(spark, sf))


@query(rf"""WITH {LINES_SQL}, f AS (SELECT *, (coalesce(trim(lag(line) OVER w), '') = '' AND regexp_matches(line, '^\d{{1,3}}\s+\p{{Lu}}')) OR regexp_matches(line, '^\d{{1,3}}\s+(Ibid\.|See\s|Cf\.\s|Id\.,)') AS note
  FROM (SELECT doc_id, line_no, CASE WHEN starts_with(line, '<!--') THEN '' ELSE line END AS line FROM fx_lines) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, sum(CASE WHEN note THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM f)
SELECT doc_id, line_no, 0 AS ord, '<!-- footnote ' || CAST(n AS VARCHAR) || ' -->' AS line FROM g WHERE note UNION ALL SELECT doc_id, line_no, 1, line FROM g""")
def c10_mark_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    return clean.mark_footnotes(fx_lines(spark, sf).withColumn("line", F.when(F.col("line").startswith("<!--"), "").otherwise(F.col("line"))))


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, pos AS par_no, CASE WHEN pos % 2 = 1 THEN 'note' ELSE 'text' END AS kind, CASE WHEN pos % 4 = 0 THEN regexp_replace(t, '[.?!]+$', '') ELSE lower(t) END AS text
   FROM (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) a FROM documents))),
c AS (SELECT *, coalesce(kind = 'text' AND lead(kind, 1) OVER w = 'note' AND lead(kind, 2) OVER w = 'text' AND NOT regexp_matches(text, '{_END}') AND regexp_matches(lead(text, 2) OVER w, '^[a-z(]'), false) AS can, lead(text, 2) OVER w AS t2 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY par_no)),
walk AS (SELECT doc_id, par_no, can, false AS gone FROM c WHERE par_no = 0
   UNION ALL SELECT c.doc_id, c.par_no, c.can AND NOT (walk.can AND false), false FROM walk JOIN c ON c.doc_id = walk.doc_id AND c.par_no = walk.par_no + CASE WHEN walk.can THEN 3 ELSE 1 END)
SELECT doc_id, par_no, kind, CASE WHEN walk.can THEN rtrim(text) || ' ' || t2 ELSE text END AS text FROM walk JOIN c USING (doc_id, par_no)
UNION ALL SELECT doc_id, c.par_no, c.kind, c.text FROM walk JOIN c USING (doc_id) WHERE walk.can AND c.par_no = walk.par_no + 1""")
def c11_merge_around_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    pos, t = F.col("pos"), F.col("t")
    p = raw_lines(spark, sf).select("doc_id", pos.alias("par_no"), F.when(pos % 2 == 1, "note").otherwise("text").alias("kind"), F.when(pos % 4 == 0, F.regexp_replace(t, "[.?!]+$", "")).otherwise(F.lower(t)).alias("text"))
    return clean.merge_around_footnotes(p)


@query(rf"""WITH {LINES_SQL}, l AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 < 2 AND trim(line) != '' AND level IS NULL THEN '## ' || line ELSE line END AS line FROM hl),
r AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level, trim(regexp_replace(line, '^#+\s+', '')) AS h FROM l WHERE trim(line) != '' AND NOT regexp_matches(line, '^\s*(\d+|\[\d+\])\s*$')),
o AS (SELECT *, CASE WHEN level IS NOT NULL AND lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM level THEN 1 ELSE 0 END AS o FROM r),
g AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM o)
SELECT doc_id, min(line_no) AS line_no, CAST(min(level) AS INT) AS level, string_agg(h, ' ' ORDER BY line_no) AS heading FROM g WHERE level IS NOT NULL GROUP BY doc_id, g""")
def c12_merge_split_headings(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    split = F.when((F.col("line_no") % 4 < 2) & (F.trim(line) != "") & heading_level(line).isNull(), F.concat(F.lit("## "), line)).otherwise(line)
    return clean.merge_split_headings(fx_lines(spark, sf).withColumn("line", split))


_TOC_SQL = "toc AS (SELECT doc_id, heading AS title, CAST(min(level) % 3 + 1 AS INT) AS level FROM hl WHERE level IS NOT NULL AND line_no % 3 != 0 GROUP BY doc_id, heading)"


def _toc(lines: DataFrame) -> DataFrame:
    return headings_of(lines).where("line_no % 3 != 0").groupBy("doc_id", F.col("heading").alias("title")).agg((F.min("level") % 3 + 1).cast("int").alias("level"))


@query(rf"""WITH {LINES_SQL}, {_TOC_SQL} SELECT hl.doc_id, hl.line_no, CASE WHEN toc.level IS NOT NULL THEN repeat('#', toc.level) || ' ' || title ELSE line END AS line
FROM hl LEFT JOIN toc ON hl.doc_id = toc.doc_id AND hl.heading = toc.title WHERE lower(trim(line)) NOT IN ('[12]', '[25]')""")
def c13_fix_heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx_lines(spark, sf)
    return clean.fix_heading_levels(lines, _toc(lines), spark.createDataFrame([("[12]",), ("[25]",)], "phrase string"))


@query(rf"""WITH {LINES_SQL}, {_TOC_SQL}, a AS (SELECT doc_id, level, count(*) AS actual FROM hl WHERE level IS NOT NULL GROUP BY 1, 2), e AS (SELECT doc_id, level, count(*) AS expected FROM toc GROUP BY 1, 2),
b AS (SELECT doc_id, level, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - coalesce(expected, 0) AS diff FROM e FULL JOIN a USING (doc_id, level))
SELECT *, CASE level WHEN 1 THEN diff = 0 WHEN 2 THEN abs(diff) <= 2 ELSE true END AS passed FROM b""")
def c14_heading_gate(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx_lines(spark, sf)
    return clean.heading_gate(lines, _toc(lines))


def _known_math(line: str) -> str:
    for formula, text in FORMULAS:
        line = f"replace({line}, '{formula}', '{text}')"
    return line


# dollar signs of the supplied texts are no formulas here; every ninth line ends in a formula of known text
_CLEAN_SQL = rf"""
dressed AS (SELECT doc_id, line_no, replace(replace(replace(line, '$12\sim34$', '@@'), '$', 'S'), '@@', '$12\sim34$') || CASE WHEN line_no % 9 = 0 THEN ' ' || [{", ".join("'" + f + "'" for f, _ in FORMULAS)}][CAST(line_no % {len(FORMULAS)} + 1 AS INT)] ELSE '' END AS line FROM fx_lines),
{_merged_sql('dressed')},
real AS (SELECT doc_id, line_no, regexp_replace(line, '([A-Za-z])Â\s*([A-Za-z])', '\1\2', 'g') AS line FROM merged WHERE NOT starts_with(line, '![image](http') AND NOT regexp_matches(line, '^\s*(\d+|\[\d+\])\s*$') AND NOT regexp_matches(line, '^[A-Za-z](?:\s+[A-Za-z0-9])+\s*$')),
spared AS (SELECT * FROM real WHERE NOT (regexp_matches(line, '\$[^$]*\\(?:mathrm|times|mathbf|text|rm|bf|it|tt|sf|sc)[^$]*\$') AND length(trim(regexp_replace(line, '\$[^$]{{1,120}}\$', '', 'g'))) < 10)),
simple AS (SELECT doc_id, line_no, regexp_replace(line, '\$\[?(\d+)\\sim(\d+)\]?\$(?:\s*\$\[?\d+\\sim\d+\]?\$)?', '\1–\2', 'g') AS line FROM spared),
told AS (SELECT doc_id, line_no, {_known_math('line')} AS line FROM simple),
titles AS (SELECT doc_id, trim(substr(line, 3)) AS t FROM merged WHERE regexp_matches(line, '^#\s+.+$') GROUP BY ALL HAVING count(*) > 1),
ranked AS (SELECT told.*, titles.t IS NOT NULL AS again, row_number() OVER (PARTITION BY told.doc_id, titles.t ORDER BY line_no) AS r FROM told LEFT JOIN titles ON titles.doc_id = told.doc_id AND regexp_matches(line, '^#\s+.+$') AND titles.t = trim(substr(line, 3)))"""


@query(f"WITH RECURSIVE {LINES_SQL}, {_CLEAN_SQL} SELECT doc_id, line_no, line FROM ranked WHERE NOT again OR r = 1")
def c_clean_books(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning job on all books."""
    n, made = F.col("line_no"), F.array(*(F.lit(f) for f, _ in FORMULAS))
    own = F.replace(F.replace(F.replace("line", F.lit(r"$12\sim34$"), F.lit("@@")), F.lit("$"), F.lit("S")), F.lit("@@"), F.lit(r"$12\sim34$"))
    line = F.concat(own, F.when(n % 9 == 0, F.concat(F.lit(" "), F.element_at(made, (n % len(FORMULAS) + 1).cast("int")))).otherwise(""))
    return clean.clean(fx_lines(spark, sf).withColumn("line", line))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, CAST(cjk AS BIGINT) AS cjk, CAST(words AS BIGINT) AS words FROM hl")
def k1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fx_lines(spark, sf).select("doc_id", "line_no", cjk_count(F.col("line")).alias("cjk"), word_count(F.col("line")).alias("words"))


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, language, CAST(CASE language WHEN 'zh' THEN 400 ELSE 150 END AS BIGINT) AS least, CAST(CASE language WHEN 'zh' THEN 2500 ELSE 1200 END AS BIGINT) AS most, CAST(CASE language WHEN 'zh' THEN 5000 ELSE 2500 END AS BIGINT) AS forced FROM lang")
def k2_k3_language(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.with_thresholds(chunking.detect_language(fx_lines(spark, sf)))


@query(f"WITH {SECTIONS_SQL} SELECT * FROM sections")
def k4_k5_sections(spark: SparkSession, sf: str) -> DataFrame:
    return fx_sections(spark, sf).drop("language", "least", "most", "forced")


@query(f"WITH {SECTIONS_SQL} SELECT * FROM units")
def k6_units(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.group_at_level(fx_sections(spark, sf))


@query(f"""WITH RECURSIVE {SECTIONS_SQL},
mains AS (SELECT u.doc_id, u.unit_no, arg_min(s.is_toc, s.level * 100000 + s.section_no) AS toc FROM units u JOIN sections s ON s.doc_id = u.doc_id AND s.section_no BETWEEN u.first_section AND u.last_section GROUP BY 1, 2),
u AS (SELECT units.*, toc, language = 'zh' AS zh, CASE WHEN language = 'zh' THEN 400 ELSE 150 END AS least, lead(units.level) OVER w AS next_level, lead(toc) OVER w AS next_toc FROM units JOIN mains USING (doc_id, unit_no) JOIN lang USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY unit_no)),
step AS (
  SELECT doc_id, unit_no, start AS open_start, units AS size, level AS main_level, toc AS main_toc, heading AS head, 0 AS n, CAST('' AS VARCHAR) AS act, start AS s0, units AS u0 FROM u WHERE false
  UNION ALL SELECT doc_id, unit_no, start, units, level, toc, heading, 0, CASE WHEN toc THEN 'toc' WHEN units < least AND next_level IS NOT NULL AND next_level != 1 AND NOT next_toc THEN 'wait' ELSE 'emit' END, start, units FROM u WHERE unit_no = 1),
walk AS (SELECT doc_id, unit_no, open_start, size, main_level, main_toc, act, CASE WHEN act = 'emit' THEN 1 ELSE 0 END AS n FROM step
  UNION ALL
  SELECT doc_id, unit_no, open_start, size, main_level, main_toc, CASE WHEN main_toc THEN 'toc' WHEN size < least AND next_level IS NOT NULL AND next_level != 1 AND NOT next_toc THEN 'wait' WHEN size < least AND next_level = 1 AND n > 0 THEN 'extend' ELSE 'emit' END,
         n + CASE WHEN main_toc OR size < least AND (next_level IS NOT NULL AND next_level != 1 AND NOT next_toc OR next_level = 1 AND n > 0) THEN 0 ELSE 1 END
  FROM (SELECT u.doc_id, u.unit_no, u.least, u.next_level, u.next_toc, w.n, CASE WHEN w.act = 'wait' THEN w.open_start ELSE u.start END AS open_start, u.units + CASE WHEN w.act = 'wait' THEN w.size ELSE 0 END AS size,
               CASE WHEN w.act = 'wait' THEN least(w.main_level, u.level) ELSE u.level END AS main_level, CASE WHEN w.act = 'wait' AND w.main_level <= u.level THEN w.main_toc ELSE u.toc END AS main_toc
        FROM walk w JOIN u ON u.doc_id = w.doc_id AND u.unit_no = w.unit_no + 1)),
ended AS (SELECT walk.*, u."end" FROM walk JOIN u USING (doc_id, unit_no))
SELECT doc_id, 'chunk' AS kind, CAST(n AS INT) AS chunk_no, min(open_start) AS start, max("end") AS "end", CAST(sum(size) AS BIGINT) AS units FROM ended WHERE act IN ('emit', 'extend') GROUP BY doc_id, n
UNION ALL SELECT doc_id, 'toc', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS INT), open_start, "end", size FROM ended WHERE act = 'toc'""")
def k7_plan_merges(spark: SparkSession, sf: str) -> DataFrame:
    """The fold with a limit that no unit passes: small units are merged, nothing is split."""
    return chunking.plan_chunks(fx_sections(spark, sf).withColumn("most", F.lit(1 << 40))).select("doc_id", "kind", "chunk_no", "start", "end", "units")


def _split_sql(n: int, top: int) -> str:
    """Stretches that are too large (item{n}: first and last section a and b, and t0, the level whose sections they begin at) cut at the first level from ``top`` on that cuts:
    pieces are walked one by one, and a stretch closes where one more piece would be too many and it isn't too small. What is still too large is item{n + 1}."""
    return f"""
cuttable{n} AS (SELECT i.*, greatest(i.deeper, (SELECT min(s.level) FROM sec s WHERE s.doc_id = i.doc_id AND s.section_no > i.a AND s.section_no <= i.b)) AS t FROM item{n} i),
piece{n} AS (
  SELECT doc_id, a AS of, t, row_number() OVER w AS p, x AS first, coalesce(lead(x) OVER w - 1, b) AS last
  FROM (SELECT c.doc_id, a, b, t, s.section_no AS x FROM cuttable{n} c JOIN sec s ON s.doc_id = c.doc_id AND s.section_no BETWEEN a AND b AND (s.section_no = a OR s.level <= t) WHERE t <= 5) WINDOW w AS (PARTITION BY doc_id, a ORDER BY x)),
sum{n} AS (SELECT p.*, u.upto - v.upto AS size, u.upto AS done, v.upto AS before FROM piece{n} p JOIN upto u ON u.doc_id = p.doc_id AND u.section_no = p.last JOIN upto v ON v.doc_id = p.doc_id AND v.section_no = p.first - 1),
pack{n} AS (
  SELECT doc_id, of, t, p, first AS c, last AS d, before, done FROM sum{n} WHERE p = 1
  UNION ALL SELECT s.doc_id, s.of, s.t, s.p, CASE WHEN s.done - k.before > l.most AND k.done - k.before >= l.least THEN s.first ELSE k.c END, s.last,
    CASE WHEN s.done - k.before > l.most AND k.done - k.before >= l.least THEN s.before ELSE k.before END, s.done FROM pack{n} k JOIN sum{n} s ON s.doc_id = k.doc_id AND s.of = k.of AND s.p = k.p + 1 JOIN limits l ON l.doc_id = s.doc_id),
stretch{n} AS (SELECT doc_id, t, c AS a, max(d) AS b, max(done) - any_value(before) AS size FROM pack{n} GROUP BY doc_id, of, t, c),
item{n + 1} AS (SELECT doc_id, a, b, size, t AS t0, t + 1 AS deeper FROM stretch{n} JOIN limits USING (doc_id) WHERE size > most),
made{n} AS (SELECT doc_id, a, b, size, t0 FROM cuttable{n} WHERE t IS NULL OR t > 5 UNION ALL SELECT doc_id, a, b, size, t FROM stretch{n} JOIN limits USING (doc_id) WHERE size <= most)"""


# sections of level 3 are put at levels 3 to 5; sizes have limits of their own so that all of the fold's branches are met
_PLAN_SQL = f"""
sec AS (SELECT doc_id, section_no, CASE WHEN level = 3 THEN 3 + section_no % 3 ELSE level END AS level, heading, start, "end", units, is_toc FROM sections),
limits AS (SELECT doc_id, CASE WHEN language = 'zh' THEN 150 ELSE 250 END AS least, CASE WHEN language = 'zh' THEN 500 ELSE 700 END AS most, CASE WHEN language = 'zh' THEN 900 ELSE 1500 END AS forced FROM lang),
upto AS (SELECT doc_id, section_no, sum(units) OVER (PARTITION BY doc_id ORDER BY section_no) AS upto FROM sec UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM sec),
opened AS (SELECT *, sum(CASE WHEN level <= 2 OR section_no = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section_no) AS k FROM sec),
bundle AS (SELECT doc_id, k, min(section_no) AS a, max(section_no) AS b, sum(units) AS size, min(level) AS main, arg_min(is_toc, level * 1000000 + section_no) AS toc FROM opened GROUP BY doc_id, k),
ahead AS (SELECT *, lead(main) OVER w AS next_main, lead(toc) OVER w AS next_toc FROM bundle JOIN limits USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
told AS (
  SELECT doc_id, k, a, b, size, main, toc, false AS made_any, CASE WHEN toc THEN 'toc' WHEN size < least AND next_main > 1 AND NOT next_toc THEN 'wait' ELSE 'emit' END AS act FROM ahead WHERE k = 1
  UNION ALL SELECT doc_id, k, a, b, size, main, toc, made_any, CASE WHEN toc THEN 'toc' WHEN size < least AND next_main > 1 AND NOT next_toc THEN 'wait' WHEN size < least AND next_main = 1 AND made_any THEN 'tail' ELSE 'emit' END
  FROM (SELECT n.doc_id, n.k, n.b, n.least, n.next_main, n.next_toc, t.made_any OR t.act = 'emit' AS made_any, CASE WHEN t.act = 'wait' THEN t.a ELSE n.a END AS a, n.size + CASE WHEN t.act = 'wait' THEN t.size ELSE 0 END AS size,
          CASE WHEN t.act = 'wait' THEN least(t.main, n.main) ELSE n.main END AS main, CASE WHEN t.act = 'wait' AND t.main <= n.main THEN t.toc ELSE n.toc END AS toc FROM told t JOIN ahead n ON n.doc_id = t.doc_id AND n.k = t.k + 1)),
item1 AS (SELECT doc_id, a, b, size, 2 AS t0, 3 AS deeper FROM told JOIN limits USING (doc_id) WHERE act = 'emit' AND size > most),
{_split_sql(1, 3)},{_split_sql(2, 4)},{_split_sql(3, 5)},
made AS (SELECT doc_id, a, b, size, 2 AS t0 FROM told JOIN limits USING (doc_id) WHERE act = 'emit' AND size <= most UNION ALL SELECT * FROM made1 UNION ALL SELECT * FROM made2 UNION ALL SELECT * FROM made3 UNION ALL SELECT doc_id, a, b, size, t0 FROM item4),
tails AS (SELECT t.doc_id, (SELECT max(m.a) FROM made m WHERE m.doc_id = t.doc_id AND m.a < t.a) AS a, max(t.b) AS b, sum(t.size) AS size FROM told t WHERE act = 'tail' GROUP BY 1, 2),
closed AS (
  SELECT m.doc_id, 'chunk' AS kind, m.a, greatest(m.b, coalesce(x.b, 0)) AS b, m.size + coalesce(x.size, 0) AS size, m.t0, CASE WHEN m.size > most THEN 'over' WHEN m.size < least AND x.a IS NULL THEN 'under' ELSE '' END AS w FROM made m JOIN limits USING (doc_id) LEFT JOIN tails x ON x.doc_id = m.doc_id AND x.a = m.a
  UNION ALL SELECT doc_id, 'toc', a, b, size, 2, '' FROM told WHERE act = 'toc'),
planned AS (
  SELECT c.doc_id, kind, CAST(row_number() OVER (PARTITION BY c.doc_id, kind ORDER BY a) AS INT) AS chunk_no, f.start, l."end", CAST(size AS BIGINT) AS units, CASE WHEN w = 'over' THEN CASE WHEN size > forced THEN 'over-force' ELSE 'over-max' END WHEN w = 'under' THEN 'under-size' ELSE '' END AS warnings,
    coalesce((SELECT arg_min(s.heading, s.section_no) FROM sec s WHERE s.doc_id = c.doc_id AND s.section_no BETWEEN a AND b AND s.level <= t0), f.heading) AS heading
  FROM closed c JOIN limits USING (doc_id) JOIN sec f ON f.doc_id = c.doc_id AND f.section_no = c.a JOIN sec l ON l.doc_id = c.doc_id AND l.section_no = c.b)"""


def _deep_plan(spark: SparkSession, sf: str, lines: DataFrame, limits: bool = False) -> DataFrame:
    level = F.when(F.col("level") == 3, 3 + F.col("section_no") % 3).otherwise(F.col("level"))
    found = fx_sections(spark, sf, lines).withColumn("level", level).drop("least", "most", "forced")
    return chunking.plan_chunks(chunking.with_thresholds(found, {"zh": (150, 500, 900), "en": (250, 700, 1500)}), limits)


@query(f"WITH RECURSIVE {SECTIONS_SQL}, {_PLAN_SQL} SELECT * FROM planned")
def k8_plan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The fold with sections at five levels."""
    return _deep_plan(spark, sf, save(fx_lines(spark, sf))).withColumn("warnings", _flat("warnings"))


@query(f"""WITH RECURSIVE {SECTIONS_SQL}, {_PLAN_SQL}, large AS (SELECT p.*, most FROM planned p JOIN limits USING (doc_id) WHERE kind = 'chunk' AND starts_with(warnings, 'over')),
b AS (SELECT c.doc_id, c.chunk_no, l.line_no, greatest(units // most, 1) AS n, row_number() OVER w - 1 AS i, greatest(count(*) OVER (PARTITION BY c.doc_id, c.chunk_no) // greatest(units // most, 1), 1) AS step FROM large c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no > c.start AND l.line_no < c."end" WHERE trim(l.line) = '' WINDOW w AS (PARTITION BY c.doc_id, c.chunk_no ORDER BY l.line_no)),
s AS (SELECT doc_id, chunk_no, string_agg(CAST(line_no AS VARCHAR), '|' ORDER BY line_no) AS candidates FROM b WHERE i >= step AND i % step = 0 AND i // step <= greatest(n, 3) GROUP BY 1, 2)
SELECT doc_id, chunk_no, start, "end", units, warnings, candidates FROM large LEFT JOIN s USING (doc_id, chunk_no)""")
def k8_large_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that stay too large, with the lines at which they may be cut by hand."""
    lines = save(fx_lines(spark, sf))
    found = chunking.large_chunks(lines, save(_deep_plan(spark, sf, lines, True)))
    return found.select("doc_id", "chunk_no", "start", "end", "units", _flat("warnings"), _flat("candidates"))


@query(f"""WITH {SECTIONS_SQL} SELECT c.doc_id, c.chunk_no, l.line_no FROM fx_chunks c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no > c.start AND l.line_no < c."end" WHERE trim(l.line) = ''""")
def k9_paragraph_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.paragraph_breaks(*fx_book(spark, sf))


@query(f"""WITH {SECTIONS_SQL}, b AS (SELECT c.doc_id, c.chunk_no, units, l.line_no, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c.doc_id, c.chunk_no) AS k FROM fx_chunks c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no > c.start AND l.line_no < c."end" WHERE trim(l.line) = '' AND units > 200 WINDOW w AS (PARTITION BY c.doc_id, c.chunk_no ORDER BY l.line_no)),
s AS (SELECT *, greatest(units // 200, 1) AS n, greatest(k // greatest(units // 200, 1), 1) AS step FROM b)
SELECT doc_id, chunk_no, string_agg(CAST(line_no AS VARCHAR), '|' ORDER BY line_no) AS candidates FROM s WHERE i >= step AND i % step = 0 AND i // step <= greatest(n, 3) GROUP BY 1, 2""")
def k10_split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    lines, chunks = fx_book(spark, sf)
    return chunking.split_candidates(chunks.withColumn("most", F.lit(200)), chunking.paragraph_breaks(lines, chunks)).withColumn("candidates", _flat("candidates"))


_SPLITS_SQL = "splits AS (SELECT c.doc_id, c.chunk_no, l.line_no, c.\"end\" FROM fx_chunks c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no > c.start AND l.line_no < c.\"end\" WHERE trim(l.line) = '' AND l.line_no % 24 = 0), cut AS (SELECT doc_id, chunk_no, start, \"end\" FROM fx_chunks UNION ALL SELECT doc_id, chunk_no, line_no, \"end\" FROM splits), sub AS (SELECT doc_id, chunk_no, CASE row_number() OVER w WHEN 1 THEN '' ELSE chr(CAST(96 + row_number() OVER w AS INT)) END AS suffix, start, coalesce(lead(start) OVER w - 1, \"end\") AS \"end\" FROM cut WINDOW w AS (PARTITION BY doc_id, chunk_no ORDER BY start))"


def _split(spark: SparkSession, sf: str) -> DataFrame:
    lines, chunks = fx_book(spark, sf)
    return chunking.apply_splits(chunks, chunking.paragraph_breaks(lines, chunks).where("line_no % 24 = 0"))


@query(f"WITH {SECTIONS_SQL}, {_SPLITS_SQL} SELECT * FROM sub")
def k11_apply_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)


@query(f"WITH {SECTIONS_SQL}, {_SPLITS_SQL} SELECT doc_id, CAST(chunk_no AS VARCHAR) || suffix AS raw_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, suffix) AS INT) AS chunk_no FROM sub")
def k12_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.renumber(_split(spark, sf).select("doc_id", F.concat(F.col("chunk_no").cast("string"), "suffix").alias("raw_id")))


@query(f"""WITH {SECTIONS_SQL} SELECT doc_id, count(*) FILTER (chunk_no % 7 != 0) AS n_chunks, count(*) FILTER (chunk_no % 7 = 0) AS n_toc, CAST(coalesce(sum(units) FILTER (chunk_no % 7 != 0), 0) AS BIGINT) AS units, count(*) FILTER (chunk_no % 7 != 0 AND units < 150) AS n_warned FROM fx_chunks GROUP BY doc_id""")
def k13_plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("chunk_no") % 7 == 0, "toc").otherwise("chunk")
    warned = F.when(F.col("units") < 150, F.array(F.lit("under-size"))).otherwise(F.array().cast("array<string>"))
    return chunking.plan_summary(fx_chunks(spark, sf).withColumns({"kind": kind, "warnings": warned}))


@query(f"""WITH {SECTIONS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM fx_chunks GROUP BY 1) SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(strlen(text) // 4 AS BIGINT) AS tokens, CAST(greatest(1, ceil(coalesce(n, 0) / 35)) AS BIGINT) AS batches FROM documents LEFT JOIN n USING (doc_id)""")
def k14_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.token_budget(table(spark, sf, "documents"), fx_chunks(spark, sf))


@query(f"""WITH {SECTIONS_SQL} SELECT c.doc_id, c.chunk_no, '来源: ' || CAST(c.doc_id AS VARCHAR) || chr(10) || '位置: ' || CAST(c.start AS VARCHAR) || '-' || CAST(c."end" AS VARCHAR) AS provenance, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body
FROM fx_chunks c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no BETWEEN c.start AND c."end" GROUP BY 1, 2, 3""")
def k15_chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_text(*fx_book(spark, sf))


_CHUNK_TEXT_SQL = f"""WITH {SECTIONS_SQL} SELECT c.doc_id, c.chunk_no, '来源: ' || CAST(c.doc_id AS VARCHAR) || chr(10) || '位置: ' || CAST(c.start AS VARCHAR) || '-' || CAST(c."end" AS VARCHAR) AS provenance, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body
FROM fx_chunks c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no BETWEEN c.start AND c."end" GROUP BY 1, 2, 3"""


@query(_CHUNK_TEXT_SQL)
def s7_write_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk texts written by bucket and read back."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    write_chunks(chunking.chunk_text(*fx_book(spark, sf)), path)
    return spark.read.parquet(path).drop("bucket")


@query(_CHUNK_TEXT_SQL)
def s7_chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk texts as a table bucketed by document."""
    name = f"chunks_{uuid.uuid4().hex}"
    return write_chunk_table(chunking.chunk_text(*fx_book(spark, sf)), name, f"{shared_dir(spark)}/{name}")


# the texts have no headings, so each is one chunk of its cleaned lines, counted anew
_INGEST_SQL = rf"""
typed AS (SELECT doc_id, CAST(generate_subscripts(a, 1) AS INT) AS line_no, unnest(a) AS line FROM (
  SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM (SELECT doc_id, replace(text, '$', 'S') AS text FROM documents WHERE text IS NOT NULL))),
{_merged_sql('typed')},
real AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, regexp_replace(line, '([A-Za-z])Â\s*([A-Za-z])', '\1\2', 'g') AS line FROM merged WHERE NOT starts_with(line, '![image](http') AND NOT regexp_matches(line, '^\s*(\d+|\[\d+\])\s*$') AND NOT regexp_matches(line, '^[A-Za-z](?:\s+[A-Za-z0-9])+\s*$'))"""


@query(f"WITH RECURSIVE {_INGEST_SQL} SELECT doc_id, 1 AS chunk_no, '来源: ' || CAST(doc_id AS VARCHAR) || chr(10) || '位置: 1-' || CAST(max(n) AS VARCHAR) AS provenance, string_agg(line, chr(10) ORDER BY n) AS body FROM real GROUP BY doc_id")
def t1_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files of an inbox, streamed through cleaning and planning."""
    path = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.replace("text", F.lit("$"), F.lit("S")).alias("text")).write.parquet(f"{path}/in")
    ingest_stream(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


_REVISED = "revised once"


@query(f"""SELECT doc_id, CAST(generate_subscripts(a, 1) AS INT) AS line_no, unnest(a) AS line FROM (
  SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '{_REVISED}' || chr(10) || text ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 3 != 2))""")
def t1_sync_inbox(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries of documents; then one of them is delivered anew with another text and one is taken away."""
    place = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).write.parquet(f"{place}/in/delivery-{k}")
    chunks = ChunkTable(spark, f"{place}/out")
    chunks.sync(f"{place}/in", make=to_lines)
    docs.where("doc_id % 3 = 1").withColumn("text", F.concat(F.lit(f"{_REVISED}\n"), "text")).write.mode("overwrite").parquet(f"{place}/in/delivery-1")
    docs.where("false").write.mode("overwrite").parquet(f"{place}/in/delivery-2")
    chunks.sync(f"{place}/in", make=to_lines)
    return chunks.rows().select("doc_id", "line_no", "line")


@query(f"""WITH {SECTIONS_SQL}, cl AS (SELECT c.doc_id, c.chunk_no, l.line_no, l.line, trim(l.line) = '' AS blank FROM fx_chunks c JOIN fx_lines l ON l.doc_id = c.doc_id AND l.line_no BETWEEN c.start AND c."end"),
e AS (SELECT *, CASE WHEN NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id, chunk_no ORDER BY line_no), true) THEN 1 ELSE 0 END AS edge FROM cl),
r AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id, chunk_no ORDER BY line_no) AS run FROM e),
m AS (SELECT *, min(line_no) FILTER (NOT blank AND regexp_matches(trim(line), '^<!--\\s*footnote\\s+\\d+\\s*-->')) OVER (PARTITION BY doc_id, chunk_no, run) AS m FROM r)
SELECT doc_id, chunk_no, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (m IS NULL OR line_no < m), '') AS body, coalesce(string_agg(line, '|' ORDER BY line_no) FILTER (line_no > m AND NOT blank), '') AS notes FROM m WHERE m IS NULL OR line_no < m OR line_no > m AND NOT blank GROUP BY 1, 2""")
def k16_chunk_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_bodies(chunking.lines_in_chunks(*fx_book(spark, sf))).withColumn("notes", _flat("notes"))


@query(f"""WITH {SECTIONS_SQL} SELECT doc_id, 'chunk' AS kind, 1 AS chunk_no, 1 AS start, max(line_no) AS "end", coalesce(arg_min(heading, line_no) FILTER (level IS NOT NULL), '') AS heading, CAST(sum(units) AS BIGINT) AS units FROM ul GROUP BY doc_id HAVING sum(units) < 4000 OR count(level) = 0""")
def k17_single_chunk(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx_lines(spark, sf)
    return chunking.single_chunk(lines, chunking.detect_language(lines), 4000).drop("warnings")


@query(f"""WITH {SECTIONS_SQL} SELECT doc_id // 100 AS doc_id, doc_id % 100 AS part, chunk_no, CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id % 100, chunk_no) AS INT) AS number FROM fx_chunks""")
def k18_concat_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Ten books as the parts of one document."""
    return chunking.concat_parts(fx_chunks(spark, sf).select(F.floor(F.col("doc_id") / 100).alias("doc_id"), (F.col("doc_id") % 100).alias("part"), "chunk_no"))
