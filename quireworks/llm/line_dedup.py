"""Substring dedup by line and passage hashing.

Texts are cut into units that their own words alone set, so that a passage gives the same units wherever it stands: at line ends, at
the ends of sentences, and, in sentences of over ``LONG`` words, at commas and at words that a checksum picks. A piece of less than
``SHORT`` words inside a line ends a unit only if its checksum says so, and is else one unit with what follows. Stretches of
neighbouring units that are just long enough (``min_words`` words or ``min_chars`` letters and digits; the shortest from each unit on, and
the shortest up to each unit) are hashed in normal form: lower case, with whatever isn't a letter or digit as a gap.
Digests are grouped globally, the earliest place by (doc_id, start) stays, and all later ones go, with their offsets in the original
text kept. Overlapping stretches are joined, so a passage of any length goes as one.

Only digests and offsets are shuffled, never texts. Places are first told apart by how often half their digest occurs, an aggregate that is
combined map-side; joins go by digest alone and have no order or window within it, so that a digest with very many places can be split.

Cases: a null, empty or blank text has no units; texts and passages below both bounds stay; what repeats within a document goes too, up to the
first place's end; rows that repeat a doc_id and its text are one document, and lose the same; a doc_id with several texts is several documents
of that rank; rows with a null doc_id take no part and are left as they are; a text is worked on whole, at some 60 bytes a character;
an empty table gives an empty result; columns beyond doc_id and text are ignored by ``repeated_passages`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import save, settled

MIN_WORDS = 20
#: For texts without spaces between words: letters and digits that count as much as ``MIN_WORDS`` words.
MIN_CHARS = 200
#: Words beyond which a sentence is cut further, and below which a piece isn't a unit of its own.
LONG, SHORT = 24, 4
#: One word of so many ends a piece in long sentences; one short piece of so many ends a unit.
WORD_CUT, PIECE_CUT = 16, 4
#: Marks by what they end.
MARKS = {"sentence": ".!?;:…", "wide sentence": "。！？；：", "clause": ",", "wide clause": "，、", "closing": "\"'”’»)]"}
_KINDS = {name: k for k, name in enumerate(MARKS, 2)}
#: Characters that are worked on at once, if a text isn't longer.
_AT_ONCE = 1 << 17


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or digit (0 for others), and the kind (1 for blanks)."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalnum():
            lower[c] = ord(y) if len(y := x.lower()) == 1 else c
    kind = np.zeros(0x110000, dtype=np.uint8)
    kind[[32, *range(9, 14)]] = 1
    for name, marks in MARKS.items():
        kind[[ord(x) for x in marks]] = _KINDS[name]
    return lower, kind


class _Rolling:
    """Hashes of stretches of a sequence, from running sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.factor, self.spread, self.start = (int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 3))
        self.kept = self._steps(2 * _AT_ONCE)

    def _steps(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The factor's powers up to ``n``, and their inverses."""
        steps = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
        return steps(self.factor), steps(pow(self.factor, -1, 1 << 64))

    def __call__(self, letters: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        powers, inverse = self.kept if len(letters) <= 2 * _AT_ONCE else self._steps(len(letters))
        x = (letters.astype(np.uint64) + np.uint64(self.start) * starts) * np.uint64(self.spread)
        x ^= x >> np.uint64(31)
        x *= np.uint64(self.spread)
        x ^= x >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)])
        return ((sums[end] - sums[begin]) * inverse[begin]).view(np.int64)


_FIRST, _SECOND = _Rolling(8), _Rolling(80)


def _ends(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs that end at the flagged places."""
    last = np.flatnonzero(flags)
    return np.concatenate([[0], last[:-1] + 1]).astype(np.int64), last


def stretches(texts: list[str], min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, ...]:
    """text (its number), start, length and two digests of the stretches that are hashed."""
    none = (np.zeros(0, dtype=np.int64),) * 5
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    lower, kind = _characters()
    low, kinds = lower[code], kind[code]
    edge = np.zeros(1, dtype=bool)  # both ends count as blank
    full = np.concatenate([edge, kinds != 1, edge])
    wide = np.concatenate([edge, (kinds == _KINDS["wide sentence"]) | (kinds == _KINDS["wide clause"]), edge])
    parted = ~full[:-1] | ~full[1:] | wide[:-1] & ~wide[1:]  # between a place and the one before
    begin, end = np.flatnonzero(full[1:-1] & parted[:-1]), np.flatnonzero(full[1:-1] & parted[1:]) + 1
    letter = low > 0
    before = np.concatenate([[0], np.cumsum(letter)])  # letters up to a place
    words = before[end] > before[begin]
    begin, end = begin[words], end[words]
    if not len(begin):
        return none
    line = np.cumsum(code == 10)[begin]
    total = np.concatenate([[0], np.cumsum(low, dtype=np.int64)])
    check = total[end] - total[begin]
    mark = kinds[end - 1]
    closed = (mark == _KINDS["closing"]) & (end - 2 >= begin)
    mark = np.where(closed, kinds[np.maximum(end - 2, 0)], mark)

    line_end = np.concatenate([line[1:] != line[:-1], [True]])
    sentence_end = line_end | (mark == _KINDS["sentence"]) | (mark == _KINDS["wide sentence"])
    a, b = _ends(sentence_end)
    in_long = np.repeat(b - a + 1 > LONG, b - a + 1)
    piece_end = sentence_end | in_long & ((mark == _KINDS["clause"]) | (mark == _KINDS["wide clause"]) | (check % WORD_CUT == 0))
    a, b = _ends(piece_end)
    unit_end = np.zeros(len(begin), dtype=bool)
    unit_end[b] = line_end[b] | (b - a + 1 >= SHORT) | (np.add.reduceat(check, a) % PIECE_CUT == 0)
    a, b = _ends(unit_end)

    start, stop = begin[a], end[b]
    text = np.searchsorted(base, start, side="right") - 1
    few, many = before[start], before[stop]
    n = np.arange(len(a))
    to = np.minimum(np.searchsorted(b, a + min_words - 1), np.searchsorted(many, few + min_chars))
    back = np.maximum(np.searchsorted(a, b + 1 - min_words, side="right"), np.searchsorted(few, many - min_chars, side="right")) - 1
    pairs = np.concatenate([np.stack([n, to])[:, to < len(n)], np.stack([back, n])[:, back >= 0]], axis=1)
    pairs = np.unique(pairs[:, text[pairs[0]] == text[pairs[1]]], axis=1)
    i, j = pairs
    letters, starts = low[letter], (letter & ~np.concatenate([[False], letter[:-1]]))[letter].astype(np.uint64)
    digests = [roll(letters, starts, few[i], many[j]) for roll in (_FIRST, _SECOND)]
    return text[i], start[i] - base[text[i]], stop[j] - start[i], *digests


def _hashed(docs: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, tag (of the text), start and length of every stretch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False), batch.column("text")
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < _AT_ONCE):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1])
                text, start, length, h1, h2 = stretches(some, min_words, min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, ids[at:][text], tags[at:][text], start, length)], ["h1", "h2", "doc_id", "tag", "start", "length"])
                at += len(some)

    named = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), _tag().alias("tag"), "text")
    return named.mapInArrow(work, "h1 bigint, h2 bigint, doc_id bigint, tag bigint, start bigint, length bigint")


def _tag():
    return F.crc32(F.col("text"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tag (of the text), start and length of what repeats earlier text, joined where it overlaps or touches; and the earliest place, kept_doc_id and
    kept_start, of what it begins with."""
    hashed = _hashed(docs, min_words, min_chars)
    often = hashed.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    again = save(hashed.join(often, "h1"))
    place = F.struct("doc_id", "tag", "start", "length")
    first = again.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.min(F.struct(F.col("doc_id"), F.col("tag"), F.col("start"))).alias("p"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "f", "p")
    first = save(first)  # a table of its own, so that Spark can split the rows of a digest with very many places in the join
    later = again.join(first, ["h1", "h2"]).where(F.struct("doc_id", "tag", "start") > F.col("p"))
    own = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("tag") == F.col("f.tag"))
    begin = F.when(own, F.greatest(F.col("start"), F.col("f.start") + F.col("f.length"))).otherwise(F.col("start"))
    spans = later.select("doc_id", "tag", begin.alias("begin"), (F.col("start") + F.col("length")).alias("end"), F.col("f.doc_id").alias("kept_doc_id"), F.col("f.start").alias("kept_start")).where("begin < end").distinct()
    # rows that repeat a document have given each of its stretches again; a document has at most two stretches a unit
    order = Window.partitionBy("doc_id", "tag").orderBy("begin", "end", "kept_doc_id", "kept_start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("begin") <= reached + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    whole = runs.groupBy("doc_id", "tag", "run").agg(F.min(F.struct("begin", "end", "kept_doc_id", "kept_start")).alias("f"), F.max("end").alias("end"))
    return whole.select("doc_id", "tag", F.col("f.begin").alias("start"), (F.col("end") - F.col("f.begin")).alias("length"), "f.kept_doc_id", "f.kept_start")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without spans (start, length), the blanks after them, and lines that this empties."""
    out, at = [], 0
    fresh = True  # nothing of a line is out yet
    for start, length in sorted(spans):
        if start > at:
            out.append(text[at:start])
            fresh = text[start - 1] == "\n"
        at = max(at, start + length)
        while at < len(text) and text[at] in " \t":
            at += 1
        if at < len(text) and text[at] == "\n" and fresh:
            at += 1
    rest, left = text[at:], "".join(out)
    return left[:-1] if spans and not rest and left.endswith("\n") else left + rest


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated passages taken out of the texts; other columns as they were."""

    def spans() -> DataFrame:
        of_text = repeated_passages(docs, min_words, min_chars).groupBy(F.col("doc_id").alias("__qw_id"), F.col("tag").alias("__qw_tag"))
        return of_text.agg(F.collect_list(F.struct("start", "length")).alias("__qw_gone"))

    gone = settled(docs.sparkSession, spans)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array((None if not t.is_valid else without(t.as_py(), [(s["start"], s["length"]) for s in g.as_py()]) for t, g in zip(texts, gone, strict=True)), pa.string())

    named = docs.withColumns({"__qw_id": F.col("doc_id").cast("bigint"), "__qw_tag": _tag()})
    joined = named.join(gone, ["__qw_id", "__qw_tag"], "left")
    has = F.col("__qw_gone").isNotNull()
    text = F.when(has, cut(F.when(has, F.col("text")), "__qw_gone")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)
