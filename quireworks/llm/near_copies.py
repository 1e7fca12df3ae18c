"""Near copies by word-shingle similarity: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

MinHash bands give candidates (32 bands of 4 values: a pair at 0.8 is missed with a probability of 5e-8), and each candidate is checked
by the exact similarity of the shingle sets. Texts with the same set are one class from the start. Not all pairs of a band's key are
checked at once: first each class with the smallest of its key, then, where a key still holds several components, the pairs across them
that their sizes, a sketch (four bits of each MinHash value) and parities (an exact bound) don't rule out, so that large groups of copies cost little more than one check a text. Pairs already in one component need no check.

SimHash links of radius 2 count too, so a component holds all that ``simhash`` joins.

Cases: a text of less than five words is one shingle; a text without words (null too) has no shingles and has SimHash links alone; rows
without a doc_id take no part and stay; rows that repeat a doc_id are one document, linked by any of
its texts; an empty table gives an empty result; very long texts have all their shingles compared; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions.graph import smallest_reachable
from quireworks.llm import simhash
from quireworks.llm.common import save, settled

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
PLANES = 4
#: Of 128 values, two sets at 0.8 differ in 24 on average in what the planes tell; in more than this with a probability of 1e-8.
MOST_UNLIKE = 50
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Parts that a set's hashes fall into, for the parities of their numbers.
PARTS = 1024
#: Pairs of one text that are checked in one place.
_TOGETHER = 64


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; none without words."""
    found = simhash._WORD.findall((text or "").encode().lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) < shingle:
        return np.array([digest(join(found), 42)], dtype=np.uint64)
    return np.unique(np.fromiter((digest(join(x), 42) for x in zip(*(found[i:] for i in range(shingle)), strict=False)), dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of ``BANDS * ROWS`` orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory for long texts
        least = np.minimum(least, (hashes[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band; keys of different bands differ too."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def planes(least: np.ndarray) -> np.ndarray:
    """Four bits of each least value, as ``PLANES`` rows of a bit a value."""
    mixed = least * _MIX
    bits = [np.packbits((mixed >> np.uint64(60 + k)) & np.uint64(1) > 0, bitorder="little") for k in range(PLANES)]
    return np.concatenate(bits).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of ``PARTS`` parts: whether an odd number of hashes falls into it. Two sets differ in at least as many hashes as bits."""
    odd = np.bincount((hashes >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differing(x: str, y: str) -> Column:
    """In how many bits two ``parities`` differ."""
    return sum((F.bit_count(F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))) for w in range(PARTS // 64)), F.lit(0))


def _unlike(x: str, y: str) -> Column:
    """In how many of their least values two sketches differ at least."""
    words = BANDS * ROWS // 64
    total = F.lit(0)
    for w in range(words):
        differs = F.lit(0).cast("bigint")
        for k in range(PLANES):
            differs = differs.bitwiseOR(F.get(x, F.lit(k * words + w)).bitwiseXOR(F.get(y, F.lit(k * words + w))))
        total = total + F.bit_count(differs)
    return total


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the shingle set, its size n, keys and planes, for texts with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for doc_id, text in zip(batch.column("doc_id")[at : at + 1000].to_pylist(), batch.column("text")[at : at + 1000], strict=True):
                    hashes = shingles(text.as_py())
                    if len(hashes):
                        least = minima(hashes)
                        rows.append((doc_id, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), len(hashes), band_keys(least).view(np.int64), planes(least)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["doc_id", "digest", "n", "keys", "planes"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, "doc_id bigint, digest binary, n bigint, keys array<bigint>, planes array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n (shingles), hashes and their parities, of each text of the documents in ``nodes`` (node)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [shingles(x.as_py()) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(map(len, found), pa.int64()), pa.array((x.tobytes() for x in found), pa.binary()), pa.array(map(parities, found), pa.list_(pa.int64()))], ["node", "n", "hashes", "parities"])

    # texts of a document that is there more than once are told apart where the join has brought them together
    texts = nodes.join(docs.select(F.col("doc_id").cast("bigint").alias("node"), "text"), "node").distinct()
    return texts.mapInArrow(work, "node bigint, n bigint, hashes binary, parities array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b: nodes) with similar enough sets; a set in many pairs is copied to several places."""
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / _TOGETHER).cast("int").alias("places"))
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    right = dealt.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"), F.col("n").alias("ny")), "b")
    left = share.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"), F.col("n").alias("nx")), "a").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
    both = right.join(left, ["a", "place"]).where((similarity * F.col("nx") <= F.col("ny")) & (similarity * F.col("ny") <= F.col("nx"))).select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                taken.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(taken, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and root, the smallest doc_id of its component, for each document that is linked to another."""
    found = save(_sketches(docs))
    classes = save(found.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in ("n", "keys", "planes")]))
    same = found.select("digest", "doc_id").join(classes.select("digest", "node"), "digest").where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    close = simhash.simhash_components(docs).where("doc_id != component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    edges = save(same.unionByName(close))

    keyed = classes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").drop("z")
    met = save(keyed.join(least, "key").select("key", "node", "a"))
    sets = save(_sets(docs, met.select("node").distinct()))

    def linked(pairs: DataFrame) -> DataFrame:
        """Edges with the similar ones of ``pairs`` added."""
        return save(edges.unionByName(_alike(pairs, sets, similarity)))

    edges = linked(save(met.where("a != node").select("a", F.col("node").alias("b")).distinct()))
    roots = smallest_reachable(edges)
    rooted = met.join(roots, "node", "left").select("key", "node", "a", F.coalesce("root", "node").alias("root"))
    # of a key's classes, those that its smallest has not drawn in meet all others; the rest is one component already
    main = F.max(F.when(F.col("node") == F.col("a"), F.col("root")))
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), main.alias("main")).where("x != y").select("key", "main")
    # a document with several texts has figures of each
    figures = sets.select("node", "n", "parities").join(classes.select("node", "planes"), "node")
    told = save(rooted.drop("a").join(several, "key").join(figures, "node"))
    left, right = (told.select("key", "main", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "planes", "parities")]) for x in "ab")
    left, right = left.where("root_a != main").drop("main"), right.withColumn("apart", F.col("root_b") != F.col("main")).drop("main")
    near = (F.col("n_a") * similarity <= F.col("n_b")) & (F.col("n_b") * similarity <= F.col("n_a")) & (_unlike("planes_a", "planes_b") <= MOST_UNLIKE)
    # sets at the similarity differ in at most this share of their sizes' sum; the rest is for rounding
    near &= _differing("parities_a", "parities_b") <= (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    once = ~F.col("apart") | (F.col("node_a") < F.col("node_b"))
    met_again = left.join(right, (left["key"] == right["key"]) & once & (F.col("root_a") != F.col("root_b")) & near)
    across = met_again.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    edges = linked(save(across))
    return smallest_reachable(edges).select(F.col("node").alias("doc_id"), "root")


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents of a component other than its smallest doc_id; rows without a doc_id stay."""
    gone = settled(docs.sparkSession, lambda: components(docs, similarity).where("doc_id != root").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
