"""The steps that columns can't express, as Arrow-batched helpers: formulas to a fixpoint, encodings, HTML and EPUB walks."""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What commands of formulas are about.
_SHELLS = {"mathrm", "textrm", "mathbf", "textbf", "textit", "text", "rm", "bf", "it", "operatorname", "boldsymbol"}
_SPACES = {"thinspace", "enspace", "quad", "qquad", "hfill", "medspace", "thickspace", "negthinspace"}
_SIGNS = {"S": "§", "circ": "°", "AA": "Å", "yen": "¥", "dag": "†", "ddag": "‡", "P": "¶", "copyright": "©"}
_TYPE_ONLY = re.compile(r"\\(?:mathrm|times|mathbf|text|rm|bf|it|tt|sf|sc|mm|cm|pt|linewidth)")
_FORMULA = re.compile(r"\$([^$\n]{1,120})\$")
#: What a formula consists of: a command, an escaped character, an opening or closing brace, a script mark, a tie, plain text.
_PART = re.compile(r"\\(?P<command>[A-Za-z]+)|\\(?P<escaped>\s+|.)|(?P<open>\{)|(?P<close>\})|(?P<script>[\^_])|(?P<tie>~)|(?P<plain>[^\\{}^_~]+|\\)", re.DOTALL)
_OPENS = re.compile(r"\s*\{")


class _Group:
    """What was read of one pair of braces; ``bare`` braces belong to no command or script."""

    def __init__(self, bare: bool):
        self.bare, self.out = bare, ""

    def closed(self) -> str:
        text = self.out.strip()
        if not self.bare or text in ("", "-", "–", ":", ".", ",") or len(text) <= 4 and text.isascii() and text.isalnum():
            return text
        return "{" + self.out + "}"


def plain_formula(inner: str) -> str:
    """What stands between two dollar signs as text: one walk over its parts, with a stack of open groups.

    Shells (font commands) and scripts give way to what they hold, spacing to a space, signs to their characters, braces around a mark,
    up to four letters or digits, or nothing to what they hold; other commands and groups stay as written. Commands count as
    whole words. Digits set apart are joined, and a hyphen between digits becomes a dash.
    """
    at, open_ = 0, [_Group(False)]
    while at < len(inner):
        part = _PART.match(inner, at)
        at, top = part.end(), open_[-1]
        kind, text = part.lastgroup, part[part.lastgroup]
        opens = _OPENS.match(inner, at)
        if kind == "open" or opens and (kind == "script" or text in _SHELLS and kind == "command"):
            open_.append(_Group(kind == "open"))
            at = opens.end() if kind != "open" else at
        elif kind == "close" and len(open_) > 1:
            open_.pop()
            open_[-1].out += top.closed()
        elif kind == "script" and text == "^":
            top.out = top.out.rstrip()
            at = re.compile(r"\s*").match(inner, at).end()
        elif kind == "tie" or kind == "escaped" and (text in ",:;!" or text.isspace()):
            top.out += " "
        elif kind == "command" and text in ("left", "right"):
            at = re.compile(r"\s*\.?(?=[(\[|)\]]?)").match(inner, at).end()
        elif kind == "command" and (text in _SPACES or text in ("hspace", "hskip")):
            argument = {"hspace": r"\s*\{[^{}]*\}", "hskip": r"\s*[^A-Za-z{}\s]*\s*"}.get(text, r"\s*")
            if (skipped := re.compile(argument).match(inner, at)) is None:
                top.out += part[0]
            else:
                top.out, at = top.out + " ", skipped.end()
        elif kind == "command":
            top.out += _SIGNS.get(text, part[0])
        else:
            top.out += part[0]
    out = open_[0].out + "".join("{" + g.out for g in open_[1:])
    out = re.sub(r"(?<!\w)\d[\d\s]*\d(?!\w)", lambda m: "".join(m[0].split()), out)
    return re.sub(r" {2,}", " ", re.sub(r"(?<=\d)\s*-\s*(?=\d)", "–", out)).strip()


def plain_math(line: str | None) -> str | None:
    """A line with its formulas as text: those of typesetting alone are dropped, real ones stay."""

    def one(m: re.Match) -> str:
        s = plain_formula(m[1])
        if not re.search(r"\\[a-zA-Z]", s):
            return s
        return "" if _TYPE_ONLY.search(m[1]) else m[0]

    return None if line is None else _FORMULA.sub(one, line)


def strip_math(line: Column) -> Column:
    def strip(lines: pd.Series) -> pd.Series:
        return lines.map(plain_math)

    return F.pandas_udf(strip, "string")(line)


def decode(data: bytes) -> str:
    """By byte order mark, else the charset named in the first 4 KB, else UTF-8 if valid, else GB 18030."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    named = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", data[:4096], re.IGNORECASE)
    if named:
        try:
            name = codecs.lookup(named[1].decode()).name
            return data.decode("gb18030" if name in ("gb2312", "gbk") else name, "replace")
        except LookupError:
            pass
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


#: Pages or books that an Arrow batch holds at most: a Python worker holds a batch, what was read of it and its results at once, and the default is 10,000.
BATCH_PAGES = 100


def _bounded(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_PAGES:
        spark.conf.set(name, str(BATCH_PAGES))


def decode_html(content: Column) -> Column:
    """The text of a page's bytes."""

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(decode, na_action="ignore")

    return F.pandas_udf(run, "string")(content)


_SKIP = {"script", "style", "nav", "footer", "aside", "noscript", "template"}
_VOID = {"br", "img", "hr", "meta", "link", "input"}
_BLOCKS = {"p", "div", "section", "article", "tr", "table", "body", "ul", "ol", "header", "main", "figure"}
_NOTE_NAME = re.compile(r"foot|note|endnote|fn", re.IGNORECASE)
#: Fixed value: what a link to a note looks like: its anchor and number.
_NOTE_LINK = re.compile(r"#((?:zw|fn|note|endnote|ftn|sdfootnote)[_-]?(\w+))", re.IGNORECASE)

#: Stands twice for each placed note's number until it is known.
_MARK = "\0"


class _Walk(HTMLParser):
    """One pass over a page: Markdown lines, and notes by anchor.

    Headings go without ``<sup>`` and marks like ``[1]``. A link to one of ``known`` notes outside headings gives way to the note,
    with a mark for its number.
    """

    def __init__(self, known: dict[str, str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.known = known or {}
        self.heading = False
        self.raised = 0
        self.link = False
        self.lines: list[str] = []
        self.now = ""
        self.skip: list[str] = []
        self.lists: list[int | None] = []
        self.quotes = 0
        self.notes: dict[str, str] = {}
        self.note: tuple[str, list[str], str] | None = None
        self.in_notes: list[str] = []

    def flush(self, gap: bool = True) -> None:
        text = re.sub(r"\s+", " ", self.now).strip()
        self.now = ""
        if re.sub(r"[*#>\-\s]|^\d+\.$", "", text):
            self.lines.append("> " * self.quotes + text)
            if gap:
                self.lines.append("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        got = {k: v or "" for k, v in attrs}
        names = f"{got.get('id', '')} {got.get('class', '')}"
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in _SKIP or re.search(r"(^|[\s_-])(ad|ads|advert)([\s_-]|$)", got.get("class", "")):
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag in ("div", "section", "ol", "ul", "aside") and _NOTE_NAME.search(names):
            self.flush()
            self.in_notes.append(tag)
        elif self.in_notes and tag in ("div", "section", "ol", "ul"):
            self.in_notes.append(tag)
        if self.in_notes and got.get("id") and tag in ("li", "p", "div"):
            self.end_note()
            self.note = (got["id"], [], tag)
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.heading = True
            self.now = "#" * min(6, int(tag[1]) + 1) + " "
        elif tag == "sup":
            self.raised += 1
        elif tag == "a" and not self.in_notes and not self.heading:
            self.place_note(got.get("href", ""))
        elif tag in _BLOCKS:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists.append(1 if tag == "ol" else None)
        elif tag == "blockquote":
            self.flush()
            self.quotes += 1
        elif tag == "li":
            self.flush(False)
            n = self.lists[-1] if self.lists else None
            self.now = "- " if n is None else f"{n}. "
            if n is not None:
                self.lists[-1] = n + 1
        elif tag == "br":
            self.now += " "
        elif tag in ("b", "strong"):
            self.now += "**"
        elif tag in ("i", "em"):
            self.now += "*"

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if self.note and tag == self.note[2]:
            self.end_note()
        if self.in_notes and tag == self.in_notes[-1]:
            self.in_notes.pop()
            self.now = ""
        if tag == "sup":
            self.raised = max(0, self.raised - 1)
        elif tag == "a":
            self.link = False
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS:
            if self.heading and tag not in _BLOCKS:
                self.now = re.sub(r"\[\d+\]", "", self.now)
                self.heading = False
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag == "blockquote":
            self.flush()
            self.quotes = max(0, self.quotes - 1)
        elif tag == "li":
            self.flush(False)
        elif tag in ("b", "strong"):
            self.now += "**"
        elif tag in ("i", "em"):
            self.now += "*"

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.note:
            self.note[1].append(data)
        if not (self.in_notes or self.link or self.heading and self.raised):
            self.now += data

    def place_note(self, href: str) -> None:
        """The note that a link leads to, by anchor, else the first whose anchor ends in the link's number."""
        found = _NOTE_LINK.search(href)
        if not found:
            return
        text = self.known.get(found[1]) or next((t for a, t in self.known.items() if a.endswith(found[2])), None)
        if text:
            self.flush()
            quote = "> " * self.quotes
            self.lines += [f"{quote}<!-- footnote {_MARK} -->", f"{quote}{_MARK} {text}", ""]
            self.link = True

    def end_note(self) -> None:
        if self.note:
            text = re.sub(r"\s+", " ", "".join(self.note[1])).strip()
            text = re.sub(r"^(?:\[?\d+\]?[.\s)]*|注\d+[:：\s]*)", "", text)
            self.notes[self.note[0]] = re.sub(r"\s*[↩↑←^]+\s*$", "", text)
            self.note = None


def walk(html: str | None, known: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """Markdown and notes of a page; ``known`` notes stand where the page links to them, with two marks each for their numbers."""
    page = _Walk(known)
    html = (html or "").replace(_MARK, "")
    body = re.search(r"(?is)<body[^>]*>(.*)", html)
    page.feed(body[1] if body else html)
    page.close()
    page.flush()
    page.end_note()
    return re.sub("\n{3,}", "\n\n", "\n".join(page.lines)).strip("\n"), page.notes


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id and markdown of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "markdown": [walk(h)[0] for h in b["html"]]})

    _bounded(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, markdown string")


def markdown_with_notes(pages: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """page_id and markdown with the notes put where the pages refer to them, numbered in that order.

    pages: page_id, html. A page's notes are its own: it is walked once for what its note containers hold, then with that. With
    ``notes`` (book, anchor, note), pages have ``book`` and ``position`` as well: the book's notes, in whatever file they stand, come
    before a page's own, and numbers run on through the book. A page gets only the notes it links to, by an equality join.
    """
    columns = ["page_id", "html"]
    given = pages.select(*columns, F.lit(None).cast("map<string,string>").alias("known"))
    if notes is not None:
        columns = ["page_id", "book", "position", "html"]
        links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(f"(?iU){_NOTE_LINK.pattern}"), F.lit(1)))
        asked = pages.select("page_id", "book", F.explode(links).alias("anchor")).join(notes.groupBy("book", "anchor").agg(F.min("note").alias("note")), ["book", "anchor"])
        known = asked.where("note IS NOT NULL").distinct().groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("anchor", "note")))).alias("known"))
        given = pages.select(*columns).join(known, "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for html, known in zip(b["html"], b["known"], strict=True):
                texts.append(walk(html, dict(known if known is not None else ()) | {a: t for a, t in walk(html)[1].items() if t})[0])
            yield b[columns[:-1]].assign(markdown=texts)

    _bounded(pages.sparkSession)
    kept = [f"{c} {given.schema[c].dataType.simpleString()}" for c in columns[:-1]]
    marked = given.mapInPandas(run, ", ".join([*kept, "markdown string"])).withColumn("parts", F.split("markdown", _MARK))
    placed = ((F.size("parts") - 1) / 2).cast("int")
    earlier = F.lit(0) if notes is None else F.sum(placed).over(Window.partitionBy("book").orderBy("position")) - placed
    numbered = F.transform("parts", lambda p, j: F.when(j == 0, p).otherwise(F.concat((F.col("earlier") + F.floor((j + 1) / 2)).cast("string"), p)))
    return marked.withColumn("earlier", earlier).select("page_id", F.array_join(numbered, "").alias("markdown"))


def html_footnotes(pages: DataFrame) -> DataFrame:
    """page_id, anchor and note, of containers named for notes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, a, t) for i, h in zip(b["page_id"], b["html"], strict=True) for a, t in walk(h)[1].items() if t]
            yield pd.DataFrame(rows, columns=["page_id", "anchor", "note"])

    _bounded(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, anchor string, note string")


def epub_spine(data: bytes) -> list[tuple[int, str, str]]:
    """(position, href, xhtml) in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        local = lambda e: e.tag.rpartition("}")[2]
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in root.iter() if local(e) == "rootfile")
        tree = ElementTree.fromstring(z.read(package))
        items = {e.get("id"): unquote(e.get("href")) for e in tree.iter() if local(e) == "item"}
        order = [items[e.get("idref")] for e in tree.iter() if local(e) == "itemref" and e.get("idref") in items]
        folder = posixpath.dirname(package)
        return [(i, h, decode(z.read(posixpath.normpath(posixpath.join(folder, h))))) for i, h in enumerate(order)]


def read_epub_spine(files: DataFrame) -> DataFrame:
    """path, position, href, xhtml of files (path, content); what is no EPUB gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(path, *x) for x in epub_spine(content)]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "position", "href", "xhtml"])

    _bounded(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, position int, href string, xhtml string")
