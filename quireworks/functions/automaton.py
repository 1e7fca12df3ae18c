"""Phrases found in lines by an Aho-Corasick automaton.

Lines and phrases are brought into the form of ``plain``. A phrase stands where its characters do; at an end that is a letter or digit of a spaced script, the line must not go on with
another such character, while scripts without spaces have no such edges. The automaton is compiled once a worker from a list whose size is checked; longer lists meet lines by their first
characters, as an equality join, and are checked by the same rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireworks.functions.text import UNSPACED, plain

#: Phrases, and characters of them, that an automaton takes (some 100 bytes a character).
MOST_PHRASES, MOST_CHARACTERS = 100_000, 1_000_000
#: Characters by which longer lists meet lines.
STARTS = (4, 3, 2, 1)
_UNSPACED = re.compile(f"[{UNSPACED} ]")
_SPACED_LETTER = rf"[\p{{L}}\p{{M}}\p{{N}}'&&[^{UNSPACED}]]"


def spaced(c: str) -> bool:
    return not _UNSPACED.match(c)


@lru_cache(maxsize=2)
def _compiled(phrases: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p, (p, spaced(p[0]), spaced(p[-1])))
    automaton.make_automaton()
    return automaton


def found_in(line: str, phrases: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """phrase and place of each phrase that stands in a line; both in plain form."""
    for end, (phrase, left, right) in _compiled(phrases).iter(line):
        at = end - len(phrase) + 1
        if not (left and at and spaced(line[at - 1])) and not (right and end + 1 < len(line) and spaced(line[end + 1])):
            yield phrase, at


def _by_automaton(lines: DataFrame, phrases: tuple[str, ...], first_only: bool) -> DataFrame:
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    out = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("line_no", kinds["line_no"]), T.StructField("line", T.StringType()), T.StructField("phrase", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str]] = []
            first: dict[tuple[object, str], int] = {}
            docs, numbers = batch.column("doc_id"), batch.column("line_no")
            for i, line in enumerate(batch.column("s")):
                here = dict.fromkeys(p for p, _ in found_in(line.as_py(), phrases)) if line.is_valid else ()
                for p in here:
                    if not first_only:
                        rows.append((i, p))
                    elif (k := first.get((d := docs[i].as_py(), p))) is None or numbers[i].as_py() < numbers[k].as_py():
                        first[d, p] = i
            rows += [(i, p) for (_, p), i in first.items()]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "line_no", "line")), pa.array([p for _, p in rows], pa.string())], ["doc_id", "line_no", "line", "phrase"])

    return lines.select("doc_id", "line_no", "line", plain(F.col("line")).alias("s")).mapInArrow(work, out)


def stands_in(line: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a line; both in plain form."""
    edge = lambda c, look: F.when(c.rlike(_SPACED_LETTER), look.format(_SPACED_LETTER)).otherwise("")
    return F.rlike(line, F.concat(edge(F.substring(phrase, 1, 1), "(?<!{})"), F.lit(r"\Q"), phrase, F.lit(r"\E"), edge(F.substring(phrase, -1, 1), "(?!{})")))


def _by_join(lines: DataFrame, phrases: DataFrame) -> DataFrame:
    size = F.lit(STARTS[-1])
    for n in reversed(STARTS):
        size = F.when(F.length("phrase") >= n, n).otherwise(size)
    asked = phrases.select("phrase", size.alias("n")).withColumn("start", F.expr("substring(phrase, 1, n)"))
    sizes = sorted(r[0] for r in asked.select("n").distinct().collect())  # four numbers at most
    s = plain(F.col("line"))
    cut = lambda n: F.when(F.length("s") >= n, F.transform(F.sequence(F.lit(1), F.length("s") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.substring("s", i, F.lit(n)).alias("start"))))
    starts = lines.select("doc_id", "line_no", s.alias("s")).select("doc_id", "line_no", F.explode(F.array_distinct(F.flatten(F.filter(F.array(*map(cut, sizes)), lambda x: x.isNotNull())))).alias("k"))
    met = starts.select("doc_id", "line_no", "k.*").join(asked, ["n", "start"]).select("doc_id", "line_no", "phrase").distinct()
    return lines.select("doc_id", "line_no", "line").join(met, ["doc_id", "line_no"]).where(stands_in(s, F.col("phrase")))


def phrases_in(lines: DataFrame, phrases: DataFrame, first_only: bool = False, most: int = MOST_PHRASES) -> DataFrame:
    """doc_id, line_no, line and phrase for lines (doc_id, line_no, line) and phrases (phrase, in plain form): once a line; ``first_only``: at least a document's first line with
    the phrase, as each batch of lines is reduced to its own first one before anything is shuffled."""
    phrases = phrases.where("phrase != ''").select("phrase").distinct()
    n, size = phrases.agg(F.count("*"), F.sum(F.length("phrase"))).first()
    if not n:
        return lines.select("doc_id", "line_no", "line", F.lit("").alias("phrase")).where("false")
    if n > most or (size or 0) > MOST_CHARACTERS:
        return _by_join(lines, phrases)
    return _by_automaton(lines, tuple(sorted(r[0] for r in phrases.collect())), first_only)
