"""From numbered lines to sized chunks: measures, sections, the planning fold, splits, and the text of chunks.

All work is keyed by document. Only the fold itself, which is sequential, leaves Spark's columns, and it sees section rows without text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quireworks.functions.carry import BLOCK, counted
from quireworks.functions.lineage import hinted, save
from quireworks.functions.text import HEADING, SPACE, cjk_count, heading_level, heading_text, ideographs_of, is_blank, strip, wide_characters, word_count

#: Least, most and forced size of a chunk by language (characters or words).
THRESHOLDS = {"zh": (400, 2500, 5000), "en": (150, 1200, 2500)}
TRAILING_NUMBER = r"(?U)\s+\d+\s*$"
#: Fixed value: the lines of a document that its language is told by.
SAMPLE = 500
CONTENTS_ENTRY = r"(?i)^(Chapter|Appendix|Part|Book)(?U)\s+"
FOOTNOTE_MARKER = r"^<!--\s*footnote\s+\d+\s*-->"


def _by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def detect_language(lines: DataFrame, sample: int = SAMPLE, share: float = 0.2) -> DataFrame:
    """doc_id and language: ``zh`` if over ``share`` of the first lines' visible characters are ideographs, else ``en``."""
    line = F.col("line")
    return _language(lines.where(F.col("line_no") <= sample).select("doc_id", ideographs_of(wide_characters(line)).alias("ideographs"), F.length(F.regexp_replace(line, SPACE, "")).alias("visible")), share)


def _language(sampled: DataFrame, share: float = 0.2) -> DataFrame:
    sums = sampled.groupBy("doc_id").agg(F.sum("ideographs").alias("c"), F.sum("visible").alias("t"))
    return sums.select("doc_id", F.when((F.col("t") > 0) & (F.col("c") > share * F.col("t")), "zh").otherwise("en").alias("language"))


def with_thresholds(docs: DataFrame, thresholds: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Adds least, most and forced to rows with a language."""
    t = thresholds or THRESHOLDS
    pick = lambda i: F.when(F.col("language") == "zh", t["zh"][i]).otherwise(t["en"][i]).cast("long")
    return docs.withColumns({"least": pick(0), "most": pick(1), "forced": pick(2)})


def measured(lines: DataFrame, languages: DataFrame) -> DataFrame:
    """Adds units to lines: Chinese characters or words, as the document's language asks."""
    line = F.col("line")
    return lines.join(languages.select("doc_id", "language"), "doc_id").withColumn("units", F.when(F.col("language") == "zh", cjk_count(line)).otherwise(word_count(line)))


def line_measures(lines: DataFrame, *more: str) -> DataFrame:
    """What planning asks of lines, and columns that they have ``more``: doc_id, line_no, title (the line, if it is a heading), words, wide (Chinese characters), entry (null unless the line ends
    in a number: whether it is an entry of contents), and ideographs and visible of the lines that tell the language. Text goes no further than here."""
    line, stripped, sampled = F.col("line"), F.col("stripped"), F.col("line_no") <= SAMPLE
    told = lines.select("doc_id", "line_no", "line", *more, strip(line).alias("stripped")).withColumns({"parts": F.split("stripped", r"(?U)\s+"), "seen": wide_characters(line)})
    # a number at the end is looked for only where the last character may be its last digit
    entry = F.when(F.right(stripped, F.lit(1)).rlike(r"(?U)\d") & line.rlike(TRAILING_NUMBER), stripped.rlike(CONTENTS_ENTRY))
    return told.select(
        "doc_id", "line_no", *more, F.when(line.rlike(HEADING), line).alias("title"), F.when(stripped != "", F.size("parts")).otherwise(0).cast("long").alias("words"), F.length("seen").cast("long").alias("wide"),
        entry.alias("entry"), F.when(sampled, ideographs_of(F.col("seen"))).alias("ideographs"), F.when(sampled, F.length(F.array_join("parts", ""))).alias("visible"),
    )


def _in_units(measures: DataFrame, languages: DataFrame) -> DataFrame:
    """Measures with units, in place of words or Chinese characters, as the document's language asks."""
    return measures.join(languages.select("doc_id", "language"), "doc_id").withColumn("units", F.when(F.col("language") == "zh", F.col("wide")).otherwise(F.col("words")))


def parse_sections(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, section_no, level, heading, start, end, units, is_toc for lines with units; text before the first heading is in none.

    A section is a table of contents if its heading says so, if most of its lines end in a number and are short, or if it holds
    several entries of parts or chapters.
    """
    return _sections(line_measures(lines, "units"), block)


def _sections(measures: DataFrame, block: int = BLOCK) -> DataFrame:
    """``parse_sections`` of measures with units: no text goes through its windows."""
    numbered = counted(measures, F.col("title").isNotNull(), "section_no", block=block).where("section_no > 0")
    title, full = F.col("title"), F.col("words") > 0
    sums = numbered.groupBy("doc_id", F.col("section_no").cast("int").alias("section_no")).agg(
        F.max(heading_level(title)).alias("level"), F.max(heading_text(title)).alias("heading"), F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.sum("units").alias("units"),
        F.count_if(full).alias("n"), F.sum(F.when(full, F.col("words"))).alias("w"), F.count_if(full & F.col("entry").isNotNull()).alias("e"), F.count_if(full & F.col("entry")).alias("c"),
    )
    toc = F.lower("heading").contains("contents") | ((F.col("e") >= 0.6 * F.col("n")) & (F.col("w") < 18 * F.col("n")) & (F.col("w") <= 600)) | ((F.col("c") >= 3) & (F.col("w") <= 400))
    return sums.select("doc_id", "section_no", "level", "heading", "start", "end", "units", toc.alias("is_toc"))


def group_at_level(sections: DataFrame, top: int = 2) -> DataFrame:
    """doc_id, unit_no, first_section, last_section, level, heading, start, end, units: a section of level ``top`` or less opens a unit."""
    w = Window.partitionBy("doc_id").orderBy("section_no")
    opens = ((F.col("level") <= top) | (F.row_number().over(w) == 1)).cast("int")
    units = sections.withColumn("o", opens).withColumn("unit_no", F.sum("o").over(w).cast("int"))
    head = F.coalesce(F.min_by("heading", F.when(F.col("level") <= top, F.col("section_no"))), F.min_by("heading", "section_no"))
    return units.groupBy("doc_id", "unit_no").agg(F.min("section_no").alias("first_section"), F.max("section_no").alias("last_section"), F.min("level").alias("level"), head.alias("heading"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("units").alias("units"))


@dataclass
class _Chunk:
    first: int
    last: int
    head: int
    size: int
    kind: str = "chunk"
    warning: str = ""


class Fold:
    """Sections of one document, by number, to chunks."""

    def __init__(self, level: list[int], size: list[int], toc: list[bool], least: int, most: int):
        self.level, self.toc, self.least, self.most = level, toc, least, most
        self.sums = [0, *accumulate(size)]

    def size(self, a: int, b: int) -> int:
        return self.sums[b] - self.sums[a]

    def head(self, a: int, b: int, top: int) -> int:
        return next((i for i in range(a, b) if self.level[i] <= top), a)

    def main(self, a: int, b: int) -> int:
        return min(range(a, b), key=self.level.__getitem__)

    def cut(self, a: int, b: int, top: int) -> list[tuple[int, int]]:
        """Stretches of [a, b) that begin at sections of level ``top`` or less."""
        return list(pairwise([a, *(i for i in range(a + 1, b) if self.level[i] <= top), b]))

    def packed(self, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Neighbours together until one more would be too many, but never less than the least."""
        a, b = pieces[0]
        for c, d in pieces[1:]:
            if self.size(a, d) > self.most and self.size(a, b) >= self.least:
                yield a, b
                a = c
            b = d
        yield a, b

    def chunk(self, a: int, b: int, top: int) -> _Chunk:
        n = self.size(a, b)
        return _Chunk(a, b - 1, self.head(a, b, top), n, warning="over" if n > self.most else "under" if n < self.least else "")

    def split(self, a: int, b: int, top: int) -> list[_Chunk]:
        """At the first level from ``top`` to 5 that cuts at all; parts still too large are split at deeper ones."""
        for t in range(top, 6):
            if len(pieces := self.cut(a, b, t)) > 1:
                out = []
                for c, d in self.packed(pieces):
                    out += self.size(c, d) > self.most and self.split(c, d, t + 1) or [self.chunk(c, d, t)]
                return out
        return []

    def run(self) -> list[_Chunk]:
        units, out, waiting = self.cut(0, len(self.level), 2), [], None
        last = None  # the newest chunk that isn't contents
        for k, (a, b) in enumerate(units):
            a, waiting = a if waiting is None else waiting, None
            if self.toc[self.main(a, b)]:
                out.append(_Chunk(a, b - 1, self.head(a, b, 2), self.size(a, b), "toc"))
                continue
            if self.size(a, b) < self.least and k + 1 < len(units):
                following = self.main(*units[k + 1])
                chapter = self.level[following] == 1
                if not chapter and not self.toc[following]:
                    waiting = a
                    continue
                if chapter and last:
                    # the tail of a chapter goes to the chunk before it, even across contents
                    last.last, last.size = b - 1, last.size + self.size(a, b)
                    last.warning = "" if last.warning == "under" else last.warning
                    continue
            out += self.size(a, b) > self.most and self.split(a, b, 3) or [self.chunk(a, b, 2)]
            last = out[-1]
        return out


_PLAN = "doc_id bigint, kind string, chunk_no int, start int, end int, heading string, units bigint, warning string, most bigint"


def plan_chunks(sections: DataFrame, limits: bool = False) -> DataFrame:
    """doc_id, kind (chunk or toc), chunk_no, start, end, heading, units, warnings for sections with least, most and forced; with ``limits`` also most.

    Warnings: ``under-size``, ``over-max`` or ``over-force``.
    """

    def fold(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("section_no", ignore_index=True)
        found = Fold(doc["level"].tolist(), doc["units"].tolist(), doc["is_toc"].tolist(), int(doc["least"].iloc[0]), int(doc["most"].iloc[0])).run()
        start, end, heading, forced = doc["start"].tolist(), doc["end"].tolist(), doc["heading"].tolist(), int(doc["forced"].iloc[0])
        numbers = {"chunk": 0, "toc": 0}
        rows = []
        for c in found:
            numbers[c.kind] += 1
            warning = {"under": "under-size", "over": "over-force" if c.size > forced else "over-max", "": ""}[c.warning]
            rows.append((doc["doc_id"].iloc[0], c.kind, numbers[c.kind], start[c.first], end[c.last], heading[c.head], c.size, warning, int(doc["most"].iloc[0])))
        return pd.DataFrame(rows, columns=["doc_id", "kind", "chunk_no", "start", "end", "heading", "units", "warning", "most"])

    thin = sections.select("doc_id", "section_no", "level", "heading", "start", "end", "units", "is_toc", "least", "most", "forced")
    # by number, as thin rows would else be put together into a task or two, in which all documents are folded one by one
    dealt = thin.repartition(int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    planned = dealt.groupBy("doc_id").applyInPandas(fold, _PLAN)
    warnings = F.when(F.col("warning") == "", F.array().cast("array<string>")).otherwise(F.array("warning"))
    return planned.select("doc_id", "kind", "chunk_no", "start", "end", "heading", "units", warnings.alias("warnings"), *(["most"] if limits else []))


def sections_of(lines: DataFrame) -> DataFrame:
    """Sections with language and thresholds, ready to be planned."""
    return sections_of_measures(save(line_measures(lines)))


def _known_languages(measures: DataFrame) -> DataFrame:
    languages = save(_language(measures.where(F.col("line_no") <= SAMPLE)))
    return hinted(languages, languages.count())


def sections_of_measures(measures: DataFrame) -> DataFrame:
    """``sections_of`` the lines that ``line_measures`` were taken of; they are read several times."""
    known = _known_languages(measures)
    return with_thresholds(_sections(_in_units(measures, known)).join(known, "doc_id"))


def fresh_numbers(lines: DataFrame) -> DataFrame:
    """Lines counted anew, where cleaning has left gaps."""
    return lines.withColumn("line_no", F.row_number().over(_by_line()))


def paragraph_breaks(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, line_no of the blank lines after a chunk's first line and before its last.

    Chunks of a document don't overlap, so each blank line is carried to the chunk that begins before it: no range join.
    """
    blank = lines.where(is_blank(F.col("line"))).select("doc_id", "line_no", F.lit(1).alias("side"), F.lit(None).cast("struct<chunk_no:int,end:int>").alias("c"))
    opens = chunks.select("doc_id", F.col("start").alias("line_no"), F.lit(0).alias("side"), F.struct("chunk_no", "end").alias("c"))
    w = Window.partitionBy("doc_id").orderBy("line_no", "side")
    carried = blank.unionByName(opens).withColumn("at", F.last("c", True).over(w)).withColumn("first", F.last(F.when(F.col("side") == 0, F.col("line_no")), True).over(w))
    return carried.where("side = 1 AND line_no > first AND line_no < at.end").select("doc_id", F.col("at.chunk_no").alias("chunk_no"), "line_no")


def split_candidates(chunks: DataFrame, breaks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, candidates: of a chunk over ``most``, every step-th of its breaks from the step-th on, ``max(n, 3)`` at most."""
    over = chunks.where(F.col("units") > F.col("most")).select("doc_id", "chunk_no", F.greatest(F.floor(F.col("units") / F.col("most")), F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id", "chunk_no")
    placed = breaks.join(over, ["doc_id", "chunk_no"]).withColumns({"i": F.row_number().over(w.orderBy("line_no")) - 1, "all": F.count("*").over(w)})
    step = F.greatest(F.floor(F.col("all") / F.col("n")), F.lit(1))
    chosen = placed.withColumn("step", step).where("i >= step AND i % step = 0 AND i div step <= greatest(n, 3)")
    return chosen.groupBy("doc_id", "chunk_no").agg(F.sort_array(F.collect_list("line_no")).alias("candidates"))


def large_chunks(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """The planned chunks (with most) that are warned of as too large, with candidates: the blank lines at which they may be cut (null if there are none)."""
    large = planned.where("kind = 'chunk' AND exists(warnings, w -> startswith(w, 'over'))")
    return large.join(split_candidates(large, paragraph_breaks(lines, large)), ["doc_id", "chunk_no"], "left")


def apply_splits(chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """doc_id, chunk_no, suffix, start, end: chunks cut before the lines of splits (doc_id, chunk_no, line_no); suffixes '', b, c, ..., after z the characters that follow it."""
    points = splits.join(chunks.select("doc_id", "chunk_no", F.col("start").alias("s"), F.col("end").alias("e")), ["doc_id", "chunk_no"]).where("line_no > s AND line_no <= e").select("doc_id", "chunk_no", F.col("line_no").alias("start"), F.col("e").alias("end")).distinct()
    w = Window.partitionBy("doc_id", "chunk_no").orderBy("start")
    parts = chunks.select("doc_id", "chunk_no", "start", "end").unionByName(points).withColumns({"k": F.row_number().over(w), "next": F.lead("start").over(w)})
    # chr would begin anew after 255
    suffix = F.when(F.col("k") == 1, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(96 + F.col("k")), 8, "0")), "UTF-32"))
    return parts.select("doc_id", "chunk_no", suffix.alias("suffix"), "start", F.coalesce(F.col("next") - 1, F.col("end")).alias("end"))


def renumber(parts: DataFrame) -> DataFrame:
    """doc_id, raw_id, chunk_no: consecutive numbers in the order of a raw id's number, then its letter, or whatever follows the number."""
    number, letter = F.regexp_extract("raw_id", r"^(\d+)", 1).cast("int"), F.regexp_extract("raw_id", r"(?s)^\d+(.*)", 1)
    return parts.select("doc_id", "raw_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(number, letter)).cast("int").alias("chunk_no"))


def plan_summary(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_toc, units and n_warned."""
    own = F.col("kind") == "chunk"
    return chunks.groupBy("doc_id").agg(F.count_if(own).alias("n_chunks"), F.count_if(~own).alias("n_toc"), F.coalesce(F.sum(F.when(own, F.col("units"))), F.lit(0)).alias("units"), F.count_if(own & (F.size("warnings") > 0)).alias("n_warned"))


def token_budget(docs: DataFrame, chunks: DataFrame, batch: int = 35) -> DataFrame:
    """doc_id, n_bytes, tokens (a quarter of the bytes) and batches."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(n, "doc_id", "left")
    return sized.select("doc_id", "n_bytes", F.floor(F.col("n_bytes") / 4).alias("tokens"), F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / batch)).cast("long").alias("batches"))


def lines_in_chunks(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds chunk_no to lines, and drops those in none.

    A chunk's line numbers, in blocks, meet the lines by equality: chunks don't overlap, and no task sorts a whole document. There are as many numbers as lines, which
    Spark doesn't see behind ``explode``, so the join is told to shuffle: the few chunks that they come from would be taken for small enough to broadcast.
    """
    first, last = F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK)
    cut = chunks.where("start <= end").select("doc_id", "chunk_no", "start", "end", F.explode(F.sequence(first, last)).alias("block"))
    numbers = F.sequence(F.greatest("start", (F.col("block") * BLOCK).cast("int")), F.least("end", ((F.col("block") + 1) * BLOCK - 1).cast("int")))
    placed = cut.select("doc_id", "chunk_no", F.explode(numbers).alias("line_no"))
    return lines.join(placed.hint("merge"), ["doc_id", "line_no"]).select("doc_id", "line_no", "line", "chunk_no")


def _ordered(value: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", value.alias("v")))), lambda x: x["v"]), "\n")


def chunk_text(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, provenance and body."""
    bodies = lines_in_chunks(lines, chunks).groupBy("doc_id", "chunk_no").agg(_ordered(F.col("line")).alias("body"))
    place = F.concat_ws("", F.lit("来源: "), F.col("doc_id").cast("string"), F.lit("\n位置: "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return bodies.join(chunks.select("doc_id", "chunk_no", place.alias("provenance")).hint("merge"), ["doc_id", "chunk_no"])


def collect_notes(chunk_lines: DataFrame) -> DataFrame:
    """doc_id, chunk_no, line_no, line, kind (body or note): in a run of lines without blanks, those after the first marker are notes.

    The marker goes, and so do the blank lines right after such a run.
    """
    w = Window.partitionBy("doc_id", "chunk_no").orderBy("line_no")
    blank = is_blank(F.col("line"))
    runs = chunk_lines.withColumn("blank", blank)
    runs = runs.withColumn("edge", (~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))).cast("int")).withColumn("run", F.sum("edge").over(w))
    marker = F.when(~F.col("blank") & strip(F.col("line")).rlike(FOOTNOTE_MARKER), F.col("line_no"))
    marked = runs.withColumn("m", F.min(marker).over(Window.partitionBy("doc_id", "chunk_no", "run")))
    kind = F.when(F.col("m").isNull() | (F.col("line_no") < F.col("m")), F.lit("body")).when((F.col("line_no") > F.col("m")) & ~F.col("blank"), F.lit("note"))
    return marked.withColumn("kind", kind).where("kind IS NOT NULL").select("doc_id", "chunk_no", "line_no", "line", "kind")


def chunk_bodies(chunk_lines: DataFrame) -> DataFrame:
    """doc_id, chunk_no, body and notes (array, in order) of ``collect_notes``."""
    found = collect_notes(chunk_lines)
    pick = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("line_no", "line")))), lambda x: x["line"])
    return found.groupBy("doc_id", "chunk_no").agg(F.array_join(pick("body"), "\n").alias("body"), pick("note").alias("notes"))


def single_chunk(lines: DataFrame, languages: DataFrame, limit: int = 400) -> DataFrame:
    """A plan of one chunk for documents of fewer than ``limit`` units, or without headings."""
    line = F.col("line")
    return _single(measured(lines, languages).select("doc_id", "line_no", "units", F.when(line.rlike(HEADING), line).alias("title")), limit)


def _single(measures: DataFrame, limit: int = 400) -> DataFrame:
    titled = F.col("title").isNotNull()
    sums = measures.groupBy("doc_id").agg(F.sum("units").alias("units"), F.max("line_no").alias("end"), F.count_if(titled).alias("h"), F.min_by(heading_text(F.col("title")), F.when(titled, F.col("line_no"))).alias("heading"))
    return sums.where((F.col("units") < limit) | (F.col("h") == 0)).select("doc_id", F.lit("chunk").alias("kind"), F.lit(1).alias("chunk_no"), F.lit(1).alias("start"), "end", F.coalesce("heading", F.lit("")).alias("heading"), "units", F.array().cast("array<string>").alias("warnings"))


def plan_documents(lines: DataFrame) -> DataFrame:
    """The plan of every document: short ones and those without headings are one chunk, the others are folded."""
    return plan_measures(save(line_measures(lines)))


def plan_measures(measures: DataFrame) -> DataFrame:
    """``plan_documents`` of the lines that ``line_measures`` were taken of. Written down, as plans are joined more than once."""
    known = _known_languages(measures)
    sized = _in_units(measures, known)
    single = save(_single(sized))
    rest = sized.join(single.select("doc_id"), "doc_id", "left_anti")
    return save(plan_chunks(with_thresholds(_sections(rest).join(known, "doc_id"))).unionByName(single))


def concat_parts(parts: DataFrame) -> DataFrame:
    """doc_id, part, chunk_no, number of (doc_id, part, chunk_no): numbers go on over the parts of a document."""
    w = Window.partitionBy("doc_id").orderBy("part")
    before = parts.groupBy("doc_id", "part").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(w) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("chunk_no"))
    return parts.select("doc_id", "part", "chunk_no", own.alias("i")).join(before.select("doc_id", "part", "offset"), ["doc_id", "part"]).select("doc_id", "part", "chunk_no", (F.col("offset") + F.col("i")).cast("int").alias("number"))
