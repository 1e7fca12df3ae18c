"""URL filters: a cascade of Bloom filters that answers exactly, without joins, for every key of the corpus.

Level 0 encodes the listed keys. Those keys of the corpus that it takes for listed by mistake are encoded by level 1, the listed keys
that level 1 takes for mistakes by level 2, and so on, until a level makes no mistake over the complete key universe. All steps are
DataFrame expressions; keys stay in tables, and only the filters, whose size is checked, become literals of the final expression, each
once. A list too long for filters of ``max_bytes`` is answered by an equality join instead, as exactly.

Cases: a null url or one without ``://`` has neither keys nor host; empty lists or tables give no levels and nothing is listed;
repeated rows get equal verdicts; rules of one length that fit alike are taken in the order of their text; null keys of the list are ignored; other columns are ignored; urls are looked at whole, however long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import ascii_lower, save


#: Bits that a byte of a filter holds: bytes below 128 are characters, so ``ascii`` reads them.
BITS = 7
#: Bits of a row in which a filter is built.
ROW_BITS = 8 * BITS


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    filter: bytes

    def holds(self, key: Column) -> Column:
        """Whether all places of ``key`` are set; the filter stands once in the expression, however many hash functions there are."""
        places = F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda k: F.pmod(F.xxhash64(key, F.lit(self.seed), k), F.lit(self.bits).cast("long")))
        byte = lambda p: F.ascii(F.substring(F.lit(self.filter), F.floor(p / BITS).cast("int") + 1, F.lit(1)).cast("string"))
        return F.forall(places, lambda p: byte(p).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(p, F.lit(BITS)).cast("int"))) != 0)


def _level(keys: DataFrame, n: int, wrong: float, seed: int, max_bytes: int) -> Level | None:
    """The filter over ``keys``, None if it is too large; bits are combined map-side, so at most one row for each eight of its bytes is shuffled."""
    hashes = max(1, min(30, round(-math.log2(wrong))))
    rows = max(1, math.ceil(n * hashes / math.log(2) / ROW_BITS))
    if rows * 8 > max_bytes:
        return None
    bits = rows * ROW_BITS
    places = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.pmod(F.xxhash64("key", F.lit(seed), k), F.lit(bits).cast("long")))).alias("p"))
    row, bit = F.floor(F.col("p") / ROW_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(ROW_BITS)).cast("int"))
    held = places.groupBy(row.alias("row")).agg(F.bit_or(bit).alias("bits")).toPandas()  # bounded by max_bytes
    found = np.zeros((rows, 8), dtype=np.uint8)
    for byte in range(8):
        found[held["row"].to_numpy(dtype=np.int64), byte] = (held["bits"].to_numpy(dtype=np.int64) >> (BITS * byte)) & 127
    return Level(bits, hashes, seed, found.tobytes())


def build_cascade(keys: DataFrame, wrong: float = 0.1, max_bytes: int = 16 << 20) -> list[Level] | None:
    """Levels over ``keys``: a row (key, listed) for each key of the universe; None if the list is too long for filters of ``max_bytes``.

    ``wrong`` is the share of mistakes that a level after the first may make.
    """
    counts = keys.agg(F.count_if("listed").alias("yes"), F.count_if(~F.col("listed")).alias("no")).first()
    n, others, levels = counts["yes"], counts["no"], []
    while n:
        share = min(0.5, max(1e-6, n / (math.sqrt(2) * max(others, 1)))) if not levels else wrong
        inside = F.col("listed") if len(levels) % 2 == 0 else ~F.col("listed")
        level = _level(keys.where(inside), n, share, len(levels), max_bytes)
        if level is None:
            return None
        levels.append(level)
        # those encoded stay; of the others, only the ones that this level mistakes go on
        keys = save(keys.where(inside | level.holds(F.col("key"))))
        others, n = n, keys.where(~inside).count()
        if len(levels) > 200:
            raise RuntimeError("the cascade doesn't end: a key is both listed and not")
    return levels


def in_cascade(levels: list[Level], key: Column) -> Column:
    """True if ``key``, one of the universe, is listed."""
    found = F.lit(False)
    for level in reversed(levels):
        found = level.holds(key) & ~found
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty for null or without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def url_keys(host: Column, path: Column) -> Column:
    """What a list may name: the host, the domains above it, and the host with its path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.array(F.concat(host, path)))))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits the host or a domain above it and the start of the path; null if none does."""
    rule = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        rule = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), F.lit(text)).otherwise(rule)
    return rule


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], wrong: float = 0.1, max_bytes: int = 16 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) for each row of ``pages`` (page_id, url).

    ``max_bytes`` bounds each filter. A url that a rule fits gets the rule's verdict, and is else blocked if ``listed`` (key) names its host, a domain above it,
    or its host with its path.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = parts.withColumn("keys", url_keys(F.col("host"), F.col("path")))
    universe = split.select(F.explode("keys").alias("key")).groupBy("key").agg(F.lit(False).alias("listed"))
    named = listed.where("key IS NOT NULL").select("key", F.lit(True).alias("listed"))
    keys = save(universe.unionByName(named).groupBy("key").agg(F.max("listed").alias("listed")))
    levels = build_cascade(keys, wrong, max_bytes)
    verdicts = dict(rules)
    by_rule = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    if levels is None:
        # by an equality join on rows of their own number, as a page may be there more than once
        split = save(split.withColumn("row", F.monotonically_increasing_id()))
        hits = split.select("row", F.explode("keys").alias("key")).join(keys.where("listed").select("key"), "key").select("row").distinct()
        split = split.join(hits.withColumn("hit", F.lit(True)), "row", "left")
        blocked = F.col("hit").isNotNull()
    else:
        blocked = F.exists("keys", lambda k: in_cascade(levels, k))
    found = split.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(blocked, "block").otherwise("allow")).alias("verdict"))
