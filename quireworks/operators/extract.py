"""Extraction from HTML pages and spine documents, by projections over whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions.text import heading_level, rstrip, strip

_META = r"(?is)<meta\s[^>]*>"


def _metas(html: Column, name: str) -> Column:
    """Contents of the meta tags whose name or property holds ``name``, in order; empty ones are left out."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"({_META})"), F.lit(1))
    key = lambda t: F.lower(F.regexp_extract(t, r"(?is)\b(?:name|property)\s*=\s*[\"']([^\"']*)", 1))
    value = lambda t: strip(F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1))
    return F.filter(F.transform(F.filter(tags, lambda t: key(t).contains(name)), value), lambda v: v != "")


def _last(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, title (the last one), authors (all), date, journal and doi (if it looks like one) of the meta tags."""
    html = F.col("html")
    doi = F.filter(_metas(html, "doi"), lambda v: v.contains("doi") | v.contains("10."))
    return pages.select("page_id", _last(_metas(html, "title")).alias("title"), _metas(html, "author").alias("authors"), _last(_metas(html, "date")).alias("date"), _last(_metas(html, "journal")).alias("journal"), _last(doi).alias("doi"))


def page_title(pages: DataFrame) -> DataFrame:
    """page_id and title: of the meta tags, else of ``<title>``, else ``Untitled``."""
    named = strip(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", F.coalesce(_last(_metas(F.col("html"), "title")), F.when(named != "", named), F.lit("Untitled")).alias("title"))


def main_content(pages: DataFrame) -> DataFrame:
    """page_id and content: the article, else the body, else all, without scripts, styles, navigation, advertisements and footers."""
    html = F.coalesce("html", F.lit(""))
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|aside)\b.*?</\1\s*>", "")
    clean = F.regexp_replace(clean, r"(?is)<div class=\"ad\">.*?</div>", "")
    article, body = F.regexp_extract(clean, r"(?is)<article[^>]*>(.*?)(?:</article>|$)", 1), F.regexp_extract(clean, r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    return pages.select("page_id", F.when(article != "", article).when(body != "", body).otherwise(clean).alias("content"))


def flat_markdown(content: DataFrame) -> DataFrame:
    """page_id and markdown of contents without nested tags: headings one level deeper, paragraphs, items; other tags are dropped."""
    c = F.col("content")
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{n}[^>]*>", "\n\n" + "#" * min(6, n + 1) + " ")
    c = F.regexp_replace(c, r"(?is)<li[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?is)</?(p|h[1-6]|ul|ol|div)\b[^>]*>", "\n\n")
    c = F.regexp_replace(c, r"(?is)<br[^>]*>", " ")
    c = F.regexp_replace(c, r"(?is)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), " ?\n ?", "\n")
    return content.select("page_id", F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\n+|\n+$", "").alias("markdown"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos and href of the anchors, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))).alias("pos", "href"))


#: Fixed value: what a link to a note looks like; the group is its number.
_NOTE_LINK = r"(?iU)(?:^|#)(?:fn|note|endnote|ftn|sdfootnote)[_-]?(\w+)"


def resolve_note_refs(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, pos, anchor, number, marker for refs (doc_id, pos, anchor) and notes (doc_id, anchor, note).

    A reference resolves by equal anchor, else by the part of its anchor after the last ``#``, else, if it looks like a link to a note,
    by its number: to the first note, by ``pos`` where notes have one, else by anchor, whose anchor ends in it. Resolved ones are
    numbered in document order, others have null number and marker.
    """
    place = F.struct(*([F.col("pos")] if "pos" in notes.columns else []), F.col("anchor"))
    exact = notes.select("doc_id", "anchor", F.col("note").alias("note1"))
    suffix = notes.select("doc_id", F.col("anchor").alias("tail"), F.col("note").alias("note2"))
    # every ending of an anchor: a reference's number meets them by equality, and a group of endings is one row before the join
    ending = F.explode(F.transform(F.sequence(F.lit(1), F.length("anchor")), lambda k: F.substring(F.col("anchor"), k, F.length("anchor"))))
    endings = notes.where("anchor != ''").select("doc_id", ending.alias("key"), "note", place.alias("place")).groupBy("doc_id", "key").agg(F.min_by("note", "place").alias("note3"))
    keyed = refs.withColumns({"tail": F.substring_index("anchor", "#", -1), "key": F.nullif(F.regexp_extract("anchor", _NOTE_LINK, 1), F.lit(""))})
    found = keyed.join(exact, ["doc_id", "anchor"], "left").join(suffix, ["doc_id", "tail"], "left").join(endings, ["doc_id", "key"], "left").withColumn("note", F.coalesce("note1", "note2", "note3"))
    has = F.col("note").isNotNull()
    n = F.when(has, F.sum(has.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")).cast("int"))
    marked = found.withColumn("number", n)
    number = F.col("number").cast("string")
    return marked.select("doc_id", "pos", "anchor", "number", F.concat(F.lit("<!-- footnote "), number, F.lit(" -->\n"), number, F.lit(" "), F.col("note"), F.lit("\n\n")).alias("marker"))


def endnote_files(links: DataFrame, least: int = 5) -> DataFrame:
    """book, target and n_sources of the files that at least ``least`` other files of the book link into (with ``#``)."""
    inside = links.where(F.col("target").contains("#")).select("book", "source", F.substring_index("target", "#", 1).alias("target")).where("source != target AND target != ''")
    return inside.groupBy("book", "target").agg(F.count_distinct("source").alias("n_sources")).where(F.col("n_sources") >= least)


def endnotes(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """book, anchor, note of anchors (book, file, pos, anchor, text) in endnote files (book, target); an anchor's last text counts."""
    kept = anchors.where(F.lower("anchor").rlike("^(zw|fn|note|endnote)")).join(files.select("book", F.col("target").alias("file")), ["book", "file"], "left_semi")
    text = strip(F.regexp_replace(F.regexp_replace("text", r"(?U)^\s*(注\d+|\[?\d+\]?)[.:：\s)]*", ""), r"(?U)\s+", " "))
    return kept.groupBy("book", "anchor").agg(F.max_by(text, "pos").alias("note"))


#: Words of a copyright page; three of them make one.
COPYRIGHT_WORDS = ("ISBN", "版权所有", "Copyright", "All rights reserved", "出版社", "Publishing", "印刷", "字数", "开本")


def content_pages(pages: DataFrame) -> DataFrame:
    """page_id of the pages (page_id, html) that are neither contents nor front matter."""
    html = F.coalesce("html", F.lit(""))
    h = F.lower(html)
    toc = (F.size(F.regexp_extract_all(h, F.lit(r"<div[^>]*class=\"[^\"]*(toc)[^\"]*\""), F.lit(1))) > 3) | h.rlike(r"class=\"[^\"]*toc-title")
    text = strip(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title)\b.*?</\1>", ""), r"(?s)<[^>]*>", ""))
    signs = sum((text.contains(w).cast("int") for w in COPYRIGHT_WORDS), F.lit(0))
    front = ~h.contains("<body") | ((F.length(text) < 50) & h.contains("<img")) | (signs >= 3)
    return pages.where(~toc & ~front).select("page_id")


def normalise_blank(docs: DataFrame) -> DataFrame:
    """doc_id and text with lines right-trimmed and four or more breaks as three."""
    trimmed = F.regexp_replace(F.col("text"), "(?m)[ \t\r\f\x0b]+$", "")
    return docs.select("doc_id", F.regexp_replace(trimmed, "\n{4,}", "\n\n\n").alias("text"))


def extract_stats(lines: DataFrame) -> DataFrame:
    """doc_id, n_lines, h2, h3, h4 and footnotes."""
    level, line = heading_level(F.col("line")), rstrip(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), *[F.count_if(level == n).alias(f"h{n}") for n in (2, 3, 4)], F.count_if(line.rlike(r"^<!-- footnote \d+ -->")).alias("footnotes"))
