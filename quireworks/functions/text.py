"""Column functions over text: line breaks, white space, counts, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text is cut into lines, the shape of a heading, and the ranges of Chinese characters.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
HEADING = r"^(#{1,6})(?U)\s+(.+)$"
CJK_WIDE = "[^\u3000-\u303f\u4e00-\u9fff]"
CJK_IDEOGRAPHS = "[^\u4e00-\u9fff]"
SPACE = r"(?U)\s"
#: The characters that SPACE matches; a test compares them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.trim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def lines_of(text: Column) -> Column:
    """Array of lines; a break at the end of the text begins no further line."""
    parts = F.split(text, LINE_BREAKS, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def cjk_count(c: Column) -> Column:
    """Chinese characters, their punctuation included."""
    return F.length(wide_characters(c)).cast("long")


def wide_characters(c: Column) -> Column:
    """The Chinese characters and punctuation of a line. A line of ASCII alone, as long in bytes as in characters, is told without a search."""
    return F.when(F.octet_length(c) == F.length(c), "").otherwise(F.regexp_replace(c, f"{CJK_WIDE}+", ""))


def ideographs_of(wide: Column) -> Column:
    """The number of ideographs among ``wide_characters``."""
    return F.length(F.regexp_replace(wide, f"{CJK_IDEOGRAPHS}+", ""))


def word_count(c: Column) -> Column:
    """Tokens between white space."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+"))).cast("long")


def heading_level(line: Column) -> Column:
    """1 to 6, or null if the line is no heading."""
    return F.when(line.rlike(HEADING), F.length(F.regexp_extract(line, HEADING, 1))).cast("int")


def heading_text(line: Column) -> Column:
    return F.when(line.rlike(HEADING), strip(F.regexp_extract(line, HEADING, 2)))


#: Scripts that put no spaces between words (Han, kana, Thai, Lao, Myanmar, Khmer), as a character class without brackets.
UNSPACED = "฀-໿က-႟ក-៿⺀-⿟々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
GAPS = r"[^\p{L}\p{M}\p{N}']+"


def plain(c: Column) -> Column:
    """In lower case, with one space for whatever isn't a letter, mark, digit or apostrophe."""
    return F.trim(F.regexp_replace(F.lower(c), GAPS, " "))


def terms_of(text: Column) -> Column:
    """Distinct terms: words of more than two characters, and, where words aren't spaced, every two neighbouring characters (a character that stands alone is a term)."""
    word = F.filter(F.split(F.regexp_replace(F.lower(text), f"[{UNSPACED}]+", " "), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2)
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{UNSPACED}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(word, pairs))
