"""Benchmark decontamination by winnowing.

Words are hashed, every ``k`` neighbouring hashes are joined to the hash of a k-gram, and of the k-grams in each window of ``span`` words the least
hash is the window's fingerprint. Two texts that share ``span`` words share a window, hence a fingerprint, whatever stands around it. Fingerprints
of documents meet those of the benchmark by equality; only texts with such a meeting are looked at again, and each meeting is extended to the words of its
window, which must equal a window of an item. All of it is built-in functions.

An item of fewer than ``span`` words is one window of its own length; its length's k-grams are the windows themselves. At most ``span`` lengths exist.

What is moved: fingerprints of the benchmark are broadcast if they are few (a number each), else a document's distinct fingerprints, with a digest of its text, are
shuffled to them. Texts with a meeting are taken once each, whatever number of documents has them. A window of a document is one string that an item's window equals or
doesn't, so neither copies nor frequent phrases make pairs.

Cases: a null text has no words and is never contaminated; a text shorter than a window meets shorter items alone; rows that repeat an item_id are one item with all
their windows, and rows with a null item_id take no part; documents keep a row each, repeated rows and null doc_ids too; an empty table on either side gives no hits; columns beyond
doc_id, text and item_id are ignored; very long texts are worked on whole, in arrays of 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import ascii_lower, hinted, save

SPAN = 10
GRAM = 8
#: Fingerprints, a number each, up to which the benchmark's are broadcast (some 40 MB).
BROADCAST_PRINTS = 1_000_000
#: What separates words after A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _with_later(a: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with the one ``by`` places on; the last ``by`` go. ``a`` is bound once, as a lambda's argument: written out thrice, it would be worked out thrice."""
    n = lambda x: F.greatest(F.size(x) - by, F.lit(0))
    return F.transform(F.array(a), lambda x: F.zip_with(F.slice(x, 1, n(x)), F.slice(x, 1 + by, n(x)), join))[0]


def _widened(a: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` over every ``n`` neighbours: widths double, then the rest is added; for a join where repeats do no harm, or n a power of two."""
    width = 1
    while 2 * width <= n:
        a, width = _with_later(a, width, join), 2 * width
    return _with_later(a, n - width, join) if width < n else a


def grams(hashes: Column, k: int) -> Column:
    """A hash of every ``k`` neighbouring hashes; blocks overlap if k isn't a power of two, which keeps equal what is equal."""
    return _widened(hashes, k, lambda x, y: F.xxhash64(x, y))


def fingerprints(words: Column, span: int, k: int) -> Column:
    """For every ``span`` neighbouring words the least hash of their ``k``-grams."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _widened(grams(hashes, min(k, span)), span - min(k, span) + 1, lambda x, y: F.least(x, y))


def _prints(words: Column, spans: list[int], k: int) -> Column:
    """An array of (span, prints)."""
    return F.array(*(F.struct(F.lit(s).alias("span"), fingerprints(words, s, k).alias("prints")) for s in spans))


def windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id (string), span and window, its words in a row, of benchmark (item_id, text)."""
    w = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    s = F.least(F.size("w"), F.lit(span))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))
    return w.select("item_id", s.alias("span"), F.explode(F.array_distinct(cut)).alias("window")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs (doc_id, text)."""
    found = save(windows(benchmark, span))
    spans = sorted(r[0] for r in found.select("span").distinct().collect())  # at most ``span`` numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.md5("text")).alias("key")
    counted = texts.select("doc_id", key, F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    none = (F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    if not spans:
        return counted.select("doc_id", "n_words", *none)
    print_of = F.lit(None).cast("bigint")
    for s in spans:
        print_of = F.when(F.col("span") == s, fingerprints(F.split("window", " "), s, gram)[0]).otherwise(print_of)
    prints = save(found.select("span", print_of.alias("print")).distinct())
    few = prints.count() <= BROADCAST_PRINTS
    wanted = F.broadcast(prints) if few else prints

    of_span = texts.select(key, F.explode(_prints(words_of(F.col("text")), spans, gram)).alias("p")).select("key", "p.span", F.col("p.prints").alias("prints"))
    met = of_span.select("key", "span", F.explode(F.array_distinct("prints")).alias("print")).join(wanted, ["span", "print"], "left_semi").select("key").distinct()
    met = save(met)
    meeting = save(texts.withColumn("key", key).join(hinted(met, met.count()), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))

    w = words_of(F.col("text"))
    places = meeting.select("key", F.explode(_prints(w, spans, gram)).alias("p")).select("key", "p.span", F.posexplode("p.prints").alias("at", "print"))
    places = places.join(wanted, ["span", "print"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "span")).alias("places"))
    cut = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["span"].alias("span"), F.array_join(F.slice(F.col("w"), p["at"] + 1, p["span"]), " ").alias("window")))
    tried = meeting.select("key", w.alias("w")).join(places, "key").select("key", F.explode(cut).alias("p")).select("key", "p.*")
    hits = save(tried.join(found.select("span", "window").distinct(), ["span", "window"], "left_semi"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(F.sort_array(F.collect_list(F.struct("at", "span"))), start, lambda a, p: F.struct((a["n"] + F.greatest(p["at"] + p["span"] - F.greatest(p["at"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], p["at"] + p["span"]).alias("to")))
    n_hit = hits.groupBy("key").agg(covered["n"].cast("bigint").alias("n_hit"))
    of_text = hits.select("key", "span", "window").distinct().join(found, ["span", "window"]).select("key", "item_id").distinct()
    items = of_text.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    results = save(n_hit.join(items, "key"))
    joined = counted.join(hinted(results, results.count()), "key", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
