"""Spelling variant grouping by a trie of letter-group counts.

A word is the vector of its counts of each letter. Two words that differ by one inserted, deleted or replaced letter have vectors that
differ by a surplus of at most one and a deficit of at most one, so a word's near ones are found by a depth-first search in the trie of vectors that may spend each
once. What the search reaches is verified letter by letter.

Spread over Spark: letters are also put into a few coarse groups, and the counts of these are the trie's topmost levels. Words with equal coarse counts are a shard. A
word is sent as a query to its own shard and to those that a surplus or a deficit of one in coarse groups leads to; of two shards with words of equal length
only one asks the other. Longer words ask for shorter ones, not the other way round, so each pair is made once, by one task. The number of coarse groups follows the number of words, so that
a shard stays within what a task holds; it changes nothing of the result.

In a task, stored words and queries are two tries (levels are sorted arrays with the places where children begin), and the search walks
both at once, a level at a time, for all queries that share a prefix: a pair of nodes stands for all their words. A pair with few words on both sides is settled by
comparing whole vectors. Words with equal vectors that are too many to compare one by one meet by what is left of them when one letter is masked.

Forms point from a word to its commonest near word, if that is at least twice as common, so they end after few steps; roots are found by doubling.

Cases: a null text has no words; a run in a row without a doc_id keeps all its letters; repeated rows count again; ties of a form go to the smallest in
code-point order; words of any length are searched (counts beyond 65,535 of a letter are equal); an empty table gives an empty result; columns
beyond doc_id and text are ignored; of very long texts only the runs travel.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import ascii_lower, hinted, save

MIN_LENGTH = 5
MIN_COUNT = 3
#: What a run is made of, and one run of so many loses a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
LOSSY = 97
#: Letters in the order of the trie's levels, frequent ones first; all others are one more group.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
GROUPS = len(LETTERS) + 1
#: Words up to which three coarse groups are enough; four times as many ask for one more.
WORDS_OF_THREE = 2_000_000
#: Words that a task gets on average, queries included.
TASK_WORDS = 60_000
#: Pairs of words below two nodes up to which they are compared at once, and of words with equal vectors beyond which masks are used.
FEW_PAIRS, MANY_PAIRS = 8, 4096
#: Pairs, of nodes or of words, that are held at once.
AT_ONCE = 1 << 17
#: Word lengths up to which letters are compared as a matrix.
SHORT = 48
SAME, LONGER = 0, 1  # queries of words of equal length, and of words with a letter less
STORED = 2


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: the runs of letters of docs (doc_id, text), A-Z in lower case, one of ``LOSSY`` without a letter that its checksum picks."""
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({RUN})"), 1)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    typed = found.withColumn("h", h).select(F.when(F.col("h") % LOSSY == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run")).alias("word"))
    return typed.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def coarse_groups(n: int) -> list[str]:
    """The letters of ``n`` coarse groups but one; all others are the last."""
    return [LETTERS[i::n] for i in range(n - 1)]


def _key(counts: list[Column]) -> Column:
    return F.xxhash64(*counts)


def _dealt(words: DataFrame, levels: int) -> DataFrame:
    """word, key and kind: each word as stored and as queries."""
    letters = coarse_groups(levels)
    named = [F.col(f"c{i}") for i in range(levels)]
    counts = {f"c{i}": F.length("word") - F.length(F.translate("word", x, "")) for i, x in enumerate(letters)}
    counted = words.select("word", *(c.alias(n) for n, c in counts.items())).withColumn(f"c{levels - 1}", F.length("word") - sum((F.col(c) for c in counts), F.lit(0)))
    moved = lambda up, down: _key([c + int(i == up) - int(i == down) for i, c in enumerate(named)])
    row = lambda key, kind, when=F.lit(True): F.when(when, F.struct(key.alias("key"), F.lit(kind).alias("kind")))
    own = F.col("own")
    to = [row(own, STORED), row(own, SAME), *(row(moved(None, j), LONGER, named[j] > 0) for j in range(levels))]
    to += [row(moved(i, j), SAME, (named[j] > 0) & (moved(i, j) > own)) for i in range(levels) for j in range(levels) if i != j]
    sent = counted.withColumn("own", _key(named)).select("word", F.explode(F.array_distinct(F.filter(F.array(*to), lambda x: x.isNotNull()))).alias("to"))
    return sent.select("word", "to.key", "to.kind")


def _letter_groups() -> np.ndarray:
    """By code point, up to the last of them that has a group of its own."""
    out = np.full(256, GROUPS - 1, dtype=np.int64)
    out[[ord(c) for c in LETTERS]] = np.arange(GROUPS - 1)
    return out


_GROUP = _letter_groups()


class _Words:
    """Words with their letters and counts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        of = np.repeat(np.arange(len(words)), self.size)
        groups = _GROUP[np.minimum(self.code, 255)]
        counts = np.bincount(of * GROUPS + groups, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        self.counts = np.minimum(counts, 65535).astype(np.int32)
        short = self.size <= SHORT
        self.letters = np.zeros((len(words), int(self.size[short].max(initial=0)) + 1), dtype=np.uint32)
        at = np.arange(len(self.code)) - np.repeat(self.start[:-1], self.size)
        some = np.repeat(short, self.size)
        self.letters[of[some], at[some]] = self.code[some]


class _Trie:
    """Rows of numbers, sorted, and for each level the rows at which its nodes begin."""

    def __init__(self, rows: np.ndarray):
        self.order = np.lexsort(rows.T[::-1])
        rows = rows[self.order]
        self.starts, self.value, self.first_child, self.child_keys = [np.zeros(min(1, len(rows)), dtype=np.int64)], [], [], []
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        for level in range(rows.shape[1]):
            new[1:] |= rows[1:, level] != rows[:-1, level]
            starts = np.flatnonzero(new)
            parents = np.searchsorted(self.starts[-1], starts, side="right") - 1
            self.first_child.append(np.concatenate([np.searchsorted(starts, self.starts[-1]), [len(starts)]]))
            self.value.append(rows[starts, level].astype(np.int64))
            self.child_keys.append(parents * (1 << 32) + self.value[-1])
            self.starts.append(starts)
        self.ends = [np.concatenate([s[1:], [len(rows)]]) if len(s) else s for s in self.starts]

    def child(self, level: int, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The children with these values of nodes above ``level``, or -1."""
        keys = self.child_keys[level]
        wanted = nodes * (1 << 32) + values
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (values >= 0), at, -1)


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes (2, 3): of (0, 0, 1, 1, 1) and within (0, 1, 0, 1, 2)."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours whose sizes add up to ``most``, or a single larger one."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), side="right")))
        yield slice(at, end)
        at = end


def _search(asked: _Trie, stored: _Trie, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of both tries, in sorted order, that may differ by these; True marks two ranges (first and end of each) of equal or near vectors instead.

    Depth first: pairs of nodes of a level are taken ``AT_ONCE`` at a time, and what they lead to before the others.
    """
    levels = len(asked.value)
    root = np.zeros(1, dtype=np.int64)
    todo = [(0, root, root, np.full(1, surplus), np.full(1, deficit))]
    while todo:
        level, a, b, s, d = todo.pop()
        na, nb = asked.ends[level][a] - asked.starts[level][a], stored.ends[level][b] - stored.starts[level][b]
        pairs = na * nb
        last = level == levels
        few = np.flatnonzero((pairs <= (MANY_PAIRS if last else FEW_PAIRS)) & (level > 0))
        for part in _slices(pairs[few], AT_ONCE):
            some = few[part]
            of, within = _ranges(pairs[some])
            wide = nb[some][of]
            yield asked.starts[level][a[some]][of] + within // wide, stored.starts[level][b[some]][of] + within % wide, False
        rest = np.ones(len(a), dtype=bool)
        rest[few] = False
        a, b, s, d = a[rest], b[rest], s[rest], d[rest]
        if last:
            for x, y in zip(a, b, strict=True):
                yield np.array([asked.starts[level][x], asked.ends[level][x]]), np.array([stored.starts[level][y], stored.ends[level][y]]), True
            continue
        if not len(a):
            continue
        of, within = _ranges(asked.first_child[level][a + 1] - asked.first_child[level][a])
        child = asked.first_child[level][a][of] + within
        value, b, s, d = asked.value[level][child], b[of], s[of], d[of]
        for step in (0, 1, -1) if level else (0,):  # the topmost level is the shard
            may = np.flatnonzero(s > 0 if step > 0 else d > 0 if step < 0 else np.ones(len(s), dtype=bool))
            to = stored.child(level, b[may], value[may] + step)
            hit = to >= 0
            may, to = may[hit], to[hit]
            todo += [(level + 1, child[may[i]], to[i], s[may[i]] - (step > 0), d[may[i]] - (step < 0)) for k in range(0, len(may), AT_ONCE) for i in [slice(k, k + AT_ONCE)]]


def _differ_once(x: _Words, y: _Words, i: np.ndarray, j: np.ndarray, kind: int) -> np.ndarray:
    """Whether word i of x becomes word j of y by one replaced letter (``SAME``), or one deleted (``LONGER``)."""
    out = x.size[i] - y.size[j] == kind
    short = (x.size[i] <= SHORT) & (y.size[j] <= SHORT) & out
    rest = np.flatnonzero(out & ~short)
    at = np.flatnonzero(short)
    width = min(x.letters.shape[1], y.letters.shape[1])
    a, b = x.letters[i[at]], y.letters[j[at]][:, :width]
    unlike = a[:, :width] != b
    if kind == SAME:
        out[at] = unlike.sum(axis=1) == 1
    else:
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        shifted = np.zeros_like(b)
        shifted[:, : a.shape[1] - 1] = a[:, 1 : width + 1]
        out[at] = ~((shifted != b) & (np.arange(width) >= first[:, None])).any(axis=1)
    for k in rest:
        out[k] = differ_once(x.words[i[k]], y.words[j[k]], kind)
    return out


def differ_once(a: str, b: str, kind: int) -> bool:
    at = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return a != b and len(a) - len(b) == kind and a[at + 1 :] == b[at + 1 - kind :]


def _by_masks(a: list[str], b: list[str], kind: int) -> Iterator[tuple[int, int]]:
    """Places of words of ``a`` and ``b`` that may be near: equal with a letter masked, or taken out of ``a``."""
    rest: dict[tuple[int, str], list[int]] = defaultdict(list)
    for j, w in enumerate(b):
        for k in range(len(w)) if kind == SAME else (0,):
            rest[k, w[:k] + w[k + 1 :] if kind == SAME else w].append(j)
    for i, w in enumerate(a):
        for j in {j for k in range(len(w)) for j in rest.get((k if kind == SAME else 0, w[:k] + w[k + 1 :]), ())}:
            yield i, j


def near_words(words: np.ndarray, keys: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that differ by one letter, of words dealt by ``_dealt``."""
    held = kinds == STORED
    stored, shards = _Words(words[held]), np.unique(keys[held])
    out_a, out_b = [words[:0]], [words[:0]]

    def trie(of: _Words, key: np.ndarray) -> _Trie:
        return _Trie(np.column_stack([np.searchsorted(shards, key), of.counts]))

    right = trie(stored, keys[held])
    for kind in (SAME, LONGER):
        mine = (kinds == kind) & np.isin(keys, shards)
        if not mine.any():
            continue
        asked = _Words(words[mine])
        left = trie(asked, keys[mine])
        for rows_a, rows_b, ranges in _search(left, right, 1 - kind, 1):
            if ranges:
                i, j = left.order[slice(*rows_a)], right.order[slice(*rows_b)]
                met = np.array(list(_by_masks(list(asked.words[i]), list(stored.words[j]), kind)), dtype=np.int64).reshape(-1, 2)
                i, j = i[met[:, 0]], j[met[:, 1]]
            else:
                i, j = left.order[rows_a], right.order[rows_b]
            for at in range(0, len(i), AT_ONCE):
                p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                more = stored.counts[q] - asked.counts[p]
                near = (np.maximum(more, 0).sum(axis=1) <= 1 - kind) & (np.maximum(-more, 0).sum(axis=1) <= 1)
                p, q = p[near], q[near]
                near = _differ_once(asked, stored, p, q, kind)
                out_a.append(asked.words[p[near]])
                out_b.append(stored.words[q[near]])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    # within a shard, words of equal length find each other both ways
    sizes = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
    own = np.equal(*sizes)
    key_of = dict(zip(stored.words, keys[held], strict=True))
    twice = own & np.fromiter((key_of.get(x) == key_of[y] and x > y for x, y in zip(a, b, strict=True)), dtype=bool, count=len(a))
    return a[~twice], b[~twice]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: the pairs of words (word, distinct) that differ by one inserted, deleted or replaced letter, once each."""
    n = words.count()
    levels = 3 + max(0, math.ceil(math.log(max(n, 1) / WORDS_OF_THREE, 4)))
    dealt = _dealt(words, levels)
    tasks = 1 + 8 * n // TASK_WORDS

    def work(table: pa.Table) -> pa.Table:
        a, b = near_words(table["word"].to_numpy(), table["key"].to_numpy(), table["kind"].to_numpy())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return dealt.groupBy(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(tasks)).alias("task")).applyInArrow(work, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for forms (word, form): where following forms ends. Each round doubles the steps taken; n at least doubles with a form, so rounds are few."""
    to = save(forms.select("word", F.col("form").alias("root")))
    while True:
        n = to.count()
        further = hinted(to.select(F.col("word").alias("root"), F.col("root").alias("next")), n)
        jumped = save(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        to = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return to


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for words (word, n)."""
    words = save(words)
    pairs = near_pairs(words.select("word"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= 2 * F.col("n")
    formed = save(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    rooted = roots(formed.where("form IS NOT NULL"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
