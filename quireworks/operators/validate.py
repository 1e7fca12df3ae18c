"""Checks of drafts and notes: each gives rows (document, place, rule, ...) of what is wrong."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from quireworks.functions.automaton import phrases_in
from quireworks.functions.carry import BLOCK, carried
from quireworks.functions.fingerprints import key_of, keys
from quireworks.functions.lineage import BROADCAST_ROWS, hinted, save
from quireworks.functions.text import CJK_WIDE, heading_level, is_blank, plain, strip
from quireworks.operators.cite import orphan_keys, unused

PAGE_MARKER = r"(?U)^\[(\d+)\]\s*$"


def _by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")

#: Type tags of references and the shape of each (author. title[tag] and what must follow).
REFERENCE_SHAPES = {
    "M": r"^.+?\. .+?\[M\]\. (?:.+\. )?[^:.]+: [^,]+, \d{4}(?:: [\d\-–, ]+)?\.$",
    "J": r"^.+?\. .+?\[J\]\. [^,]+, \d{4}(?:, ?\d+)?(?:\(\d+\))?(?:: [\d\-–+, ]+)?\.$",
    "D": r"^.+?\. .+?\[D\]\. [^:.]+: [^,]+, \d{4}(?:: [\d\-–, ]+)?\.$",
    "C": r"^.+?\. .+?\[C\]\. [^:.]+: [^,]+, \d{4}(?:: [\d\-–, ]+)?\.$",
    "N": r"^.+?\. .+?\[N\]\. [^,]+, \d{4}-\d{2}-\d{2}(?:\(\d+\))?\.$",
    "R": r"^.+?\. .+?\[R\]\. [^:.]+: [^,]+, \d{4}\.$",
    "S": r"^.+?\. .+?\[S\]\. [^:.]+: [^,]+, \d{4}\.$",
    "EB/OL": r"^.+?\. .+?\[EB/OL\]\. (?:\(\d{4}-\d{2}-\d{2}\))?\[\d{4}-\d{2}-\d{2}\]\. https?://\S+?\.?$",
    "G": r"^.+?\. .+?\[G\]\. [^:.]+: [^,]+, \d{4}\.$",
    "A": r"^.+?\. .+?\[A\]\. .+\[C\]\. [^:.]+: [^,]+, \d{4}: [\d\-–]+\.$",
}


def cross_check(cites: DataFrame, defs: DataFrame) -> DataFrame:
    """thesis_id, key, rule: ``undefined`` or ``unused``."""
    return orphan_keys(cites, defs).withColumn("rule", F.lit("undefined")).unionByName(unused(cites, defs).withColumn("rule", F.lit("unused")))


def page_of_line(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds page: of the nearest marker at or before the line; null before the first."""
    mark = F.when(F.col("line").rlike(PAGE_MARKER), F.regexp_extract("line", PAGE_MARKER, 1).cast("int"))
    return carried(lines, mark, "page", block=block)


def check_pages(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """note_id, rule, severity for notes (note_id, doc_id, chunk_no, page_from, page_to) and pages (doc_id, chunk_no, page).

    ``page-absent`` if neither page is in the chunk, ``page-missing`` if the chunk has pages and the note none, ``page-invented``
    if only the note has one.
    """
    keys = ["doc_id", "chunk_no"]
    n = pages.groupBy(*keys).agg(F.count("*").alias("n"))
    found = notes.join(pages, keys).where(F.col("page").between(F.col("page_from"), F.coalesce("page_to", "page_from"))).select("note_id").distinct().withColumn("hit", F.lit(True))
    seen = notes.join(n, keys, "left").join(found, "note_id", "left")
    has, given = F.coalesce(F.col("n"), F.lit(0)) > 0, F.col("page_from").isNotNull()
    rule = F.when(has & given & F.col("hit").isNull(), "page-absent").when(has & ~given, "page-missing").when(~has & given, "page-invented")
    return seen.withColumn("rule", rule).where("rule IS NOT NULL").select("note_id", "rule", F.when(F.col("rule") == "page-missing", "warning").otherwise("error").alias("severity"))


def quote_pages(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """quote_id and pages (``230`` or ``230-231``) of quotes (quote_id, doc_id, first_line, last_line); null without markers.

    The pages at a quote's two ends are looked up by equality on the line.
    """
    paged = page_of_line(lines).select("doc_id", "line_no", "page")
    at = lambda end, name: paged.select("doc_id", F.col("line_no").alias(end), F.col("page").alias(name))
    both = quotes.join(at("first_line", "a"), ["doc_id", "first_line"], "left").join(at("last_line", "b"), ["doc_id", "last_line"], "left")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    return both.select("quote_id", F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).alias("pages"))


def segments(quote: Column) -> Column:
    """The parts of a quotation between ellipses."""
    return F.filter(F.transform(F.split(quote, r"……|…|\.\.\."), strip), lambda s: s != "")


def in_order(parts: Column, body: Column) -> Column:
    """Whether all parts are in the body, each after the one before."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(a: Column, s: Column) -> Column:
        place = F.call_function("locate", s, body, a["at"])
        return F.struct(F.when(place > 0, place + F.length(s)).otherwise(a["at"]).alias("at"), (a["ok"] & (place > 0)).alias("ok"))

    return F.aggregate(parts, start, step)["ok"]


def check_verbatim(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quote_id and verbatim for quotes (quote_id, doc_id, chunk_no, quote) and chunks (doc_id, chunk_no, body).

    All segments must be in the chunk, each after the one before.
    """
    joined = quotes.join(chunks.select("doc_id", "chunk_no", "body"), ["doc_id", "chunk_no"], "left")
    return joined.select("quote_id", F.coalesce(in_order(segments(F.col("quote")), F.col("body")), F.lit(False)).alias("verbatim"))


def find_verbatim(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quote_id, doc_id, chunk_no of the chunks (doc_id, chunk_no, body) that hold a quote (quote_id, quote) whose source isn't given: all its
    segments, each after the one before, as ``check_verbatim`` has it.

    Candidates meet by a key of the longest segment's beginning: a winnowed fingerprint if it has 32 characters, else its first 16, 8, 4, 2 or 1. Bodies give keys of the asked
    lengths alone, and these are filtered by the asked keys before anything is shuffled (in the tasks themselves, if few are asked for). Quotes without a segment, null bodies and chunks without ids are in no row.
    """
    parts = segments(F.col("quote"))
    longest = F.array_max(F.transform("parts", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]

    @F.arrow_udf("size int, key bigint")
    def asked_key(stretches: pa.Array) -> pa.Array:
        found = [key_of(s.as_py()) for s in stretches]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int64())], ["size", "key"])

    asked = save(quotes.select("quote_id", parts.alias("parts")).where(F.size("parts") > 0).withColumn("k", asked_key(longest)).select("quote_id", "parts", "k.*"))
    wanted = asked.select("size", "key").distinct()
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # six numbers at most
    n_asked = asked.count()
    few: dict[int, np.ndarray] = {}  # keys by size, where they are few enough to go to every task
    if n_asked <= BROADCAST_ROWS:
        rows = wanted.collect()
        few = {size: np.unique(np.array([r["key"] for r in rows if r["size"] == size], dtype=np.int64)) for size in sizes}
    names = ["doc_id", "chunk_no", "size", "key"]
    kinds = T.StructType([*(T.StructField(c, chunks.schema[c].dataType) for c in names[:2]), T.StructField("size", T.IntegerType()), T.StructField("key", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                for size in sizes:
                    found = keys(body.as_py(), size)
                    if few:
                        found = np.intersect1d(found, few[size], assume_unique=True)
                    at = pa.array(np.full(len(found), i))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("chunk_no").take(at), pa.array(np.full(len(found), size, dtype=np.int32)), pa.array(found)], names)

    bodies = chunks.where("body IS NOT NULL").select("doc_id", "chunk_no", "body")
    met = save(bodies.mapInArrow(work, kinds).join(hinted(wanted, n_asked), ["size", "key"], "left_semi"))
    places = met.select("doc_id", "chunk_no").distinct()
    held = bodies.join(hinted(places, met.count()), ["doc_id", "chunk_no"], "left_semi")
    tried = met.join(asked, ["size", "key"]).join(held, ["doc_id", "chunk_no"])
    return tried.where(in_order(F.col("parts"), F.col("body"))).select("quote_id", "doc_id", "chunk_no").distinct()


def check_hierarchy(headings: DataFrame) -> DataFrame:
    """doc_id, line_no, level, previous where a level rises by more than one."""
    return headings.withColumn("previous", F.lag("level").over(_by_line())).where("level > previous + 1").select("doc_id", "line_no", "level", "previous")


def check_numbering(headings: DataFrame) -> DataFrame:
    """doc_id, line_no, rule: ``number-depth`` (not as many figures as the level), ``chinese-ordinal``, ``number-gap``."""
    number = F.regexp_extract("heading", r"^(\d+(?:\.\d+)*)(?=[\s　]|$)", 1)
    figures = F.split(number, r"\.")
    w = Window.partitionBy("doc_id", "level").orderBy("line_no")
    h = headings.withColumns({"number": number, "depth": F.when(number == "", 0).otherwise(F.size(figures)), "last": F.when(number != "", F.element_at(figures, -1).cast("int")), "stem": F.regexp_extract("heading", r"^((?:\d+\.)*)\d+(?=[\s　]|$)", 1)})
    before = h.withColumns({"p": F.lag("last").over(w), "ps": F.lag("stem").over(w)})
    ordinal = F.col("heading").rlike("^(第[一二三四五六七八九十百]+[章节]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）)")
    gap = (F.col("depth") > 0) & (F.col("ps") == F.col("stem")) & (F.col("last") != F.col("p") + 1)
    rules = F.filter(F.array(F.when(ordinal, F.lit("chinese-ordinal")), F.when(~ordinal & (F.col("level") <= 3) & (F.col("depth") != F.col("level")), F.lit("number-depth")), F.when(gap, F.lit("number-gap"))), lambda x: x.isNotNull())
    return before.select("doc_id", "line_no", F.explode(rules).alias("rule"))


def outline_diff(headings: DataFrame, outline: DataFrame) -> DataFrame:
    """thesis_id, section_no, rule: ``missing``, ``extra`` or ``wrong-level`` of headings and outline (thesis_id, section_no, level)."""
    a, b = headings.select("thesis_id", "section_no", F.col("level").alias("is")), outline.select("thesis_id", "section_no", F.col("level").alias("should"))
    both = a.join(b, ["thesis_id", "section_no"], "full_outer")
    rule = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "extra").when(F.col("is") != F.col("should"), "wrong-level")
    return both.withColumn("rule", rule).where("rule IS NOT NULL").select("thesis_id", "section_no", "rule")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, par_no, first_line, n_chars of runs of lines that are neither blank nor headings."""
    line = F.col("line")
    text = ~is_blank(line) & heading_level(line).isNull()
    w = _by_line()
    marked = lines.withColumn("text", text).withColumn("o", (F.col("text") & ~F.coalesce(F.lag("text").over(w), F.lit(False))).cast("int")).withColumn("par_no", F.sum("o").over(w).cast("int"))
    return marked.where("text").groupBy("doc_id", "par_no").agg(F.min("line_no").alias("first_line"), F.sum(F.length("line")).alias("n_chars"))


def check_paragraphs(lines: DataFrame, low: int, high: int) -> DataFrame:
    """doc_id, first_line, n_chars, rule: ``too-short`` or ``too-long``."""
    found = paragraphs(lines).where((F.col("n_chars") < low) | (F.col("n_chars") > high))
    return found.select("doc_id", "first_line", "n_chars", F.when(F.col("n_chars") < low, "too-short").otherwise("too-long").alias("rule"))


def check_reference_format(refs: DataFrame) -> DataFrame:
    """Adds tag and ok to refs (ref_id, reference): the type tag, and whether the shape of its type fits; no tag isn't ok."""
    tag = F.regexp_extract("reference", r"\[(M|J|D|C|N|R|S|EB/OL|G|A)\]", 1)
    ok = F.lit(False)
    for name, shape in REFERENCE_SHAPES.items():
        ok = F.when(tag == name, F.col("reference").rlike(shape)).otherwise(ok)
    return refs.select("ref_id", F.nullif(tag, F.lit("")).alias("tag"), ok.alias("ok"))


def format_reference(bib: DataFrame, missing: str = "[待补充]") -> DataFrame:
    """ref_id and reference of bib (ref_id, type, author, title, place, publisher, journal, year, issue, pages)."""
    need = lambda c: F.coalesce(F.nullif(strip(F.col(c).cast("string")), F.lit("")), F.lit(missing))
    tail = lambda c, before: F.when(F.col(c).isNotNull(), F.concat(F.lit(before), F.col(c))).otherwise("")
    head = F.concat(need("author"), F.lit(". "), need("title"), F.lit("["), F.col("type"), F.lit("]. "))
    journal = F.concat(need("journal"), F.lit(", "), need("year"), tail("issue", ", "), tail("pages", ": "), F.lit("."))
    book = F.concat(need("place"), F.lit(": "), need("publisher"), F.lit(", "), need("year"), tail("pages", ": "), F.lit("."))
    return bib.select("ref_id", F.concat(head, F.when(F.col("type") == "J", journal).otherwise(book)).alias("reference"))


def forbidden_marks(lines: DataFrame) -> DataFrame:
    """Rows of lines with pos, mark and rule: ``numeric-marker`` for ``[1]``, ``inline-page`` for ``(6:225)``; page lines are none."""
    hits = F.regexp_extract_all("line", F.lit(r"(\[\d+\]|\(\d+:\d+(?:-\d+)?\))"), F.lit(1))
    keys = [c for c in lines.columns if c != "line"]
    found = lines.where(~F.col("line").rlike(PAGE_MARKER)).select(*keys, F.posexplode(hits).alias("pos", "mark"))
    return found.withColumn("rule", F.when(F.col("mark").startswith("["), "numeric-marker").otherwise("inline-page"))


def check_sequence(markers: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, number, previous, rule for markers (doc_id, line_no, pos, number): ``repeat``, ``gap`` or ``back``."""
    w = Window.partitionBy("doc_id").orderBy("line_no", "pos")
    before = markers.withColumn("previous", F.coalesce(F.lag("number").over(w), F.lit(0)))
    rule = F.when(F.col("number") == F.col("previous"), "repeat").when(F.col("number") < F.col("previous"), "back").when(F.col("number") > F.col("previous") + 1, "gap")
    return before.withColumn("rule", rule).where("rule IS NOT NULL").select("doc_id", "line_no", "pos", "number", "previous", "rule")


def _held(lines: DataFrame, terms: DataFrame, column: str, first_only: bool = False) -> DataFrame:
    """Rows of terms with the lines that hold their ``column``, as words of their own where the script has spaces between words."""
    named = terms.withColumn("phrase", plain(F.col(column)))
    found = phrases_in(lines.select("doc_id", "line_no", "line"), named, first_only)
    return found.join(hinted(named, named.count()), "phrase").drop("phrase")


def term_variants(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, translations (sorted) for terms (term, translation) of which a document uses several translations."""
    seen = _held(lines, terms.select("term", F.lower("translation").alias("word")), "word", True)
    return seen.groupBy("doc_id", "term").agg(F.sort_array(F.collect_set("word")).alias("t")).where(F.size("t") > 1).select("doc_id", "term", F.array_join("t", ",").alias("translations"))


def first_use(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, word, line_no where the first line that uses a word of terms (word, original) lacks the original form."""
    first = _held(lines, terms.select(F.lower("word").alias("word"), "original"), "word", True).groupBy("doc_id", "word", "original").agg(F.min_by(F.struct("line_no", "line"), "line_no").alias("f"))
    return first.where(~F.contains("f.line", "original")).select("doc_id", "word", F.col("f.line_no").alias("line_no"))


def lexicon_hits(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, line_no, phrase (in lower case) for the phrases of a lexicon, of any number of words, that a line holds."""
    return _held(lines, lexicon.select(F.lower("phrase").alias("lexeme")).distinct(), "lexeme").select("doc_id", "line_no", F.col("lexeme").alias("phrase"))


def report(findings: DataFrame) -> DataFrame:
    """doc_id, severity, n: counts for each document and severity, with totals (null) of each document and of all."""
    return findings.rollup("doc_id", "severity").agg(F.count("*").alias("n"))


def order_refs(refs: DataFrame) -> DataFrame:
    """Adds place to refs (doc_id, reference): Chinese ones before foreign ones, then by text."""
    foreign = (F.length(F.regexp_replace(F.regexp_extract("reference", r"^([^.]*)", 1), CJK_WIDE, "")) == 0).cast("int")
    return refs.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(foreign, "reference")).cast("int"))


def check_meta(notes: DataFrame, library: DataFrame) -> DataFrame:
    """note_id, work, stored of notes (note_id, work, citation) that differ from the library's (work, stored)."""
    return notes.join(library, "work").where(strip(F.col("citation")) != strip(F.col("stored"))).select("note_id", "work", "stored")

