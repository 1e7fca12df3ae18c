"""SimHash near-dedup by covering locality-sensitive hashing.

Bits of a fingerprint get non-zero vectors of r + 1 bits; table v (one for each non-zero vector v) keeps the bits whose vector has an
odd product with v. Whichever r bits two fingerprints differ in, some v is orthogonal to all their vectors, so the two are equal in
table v: every pair within radius r meets, and 2 ** (r + 1) - 1 tables do.

Equal fingerprints are one class from the start. In a table, only keys that several classes share are looked at. There no pairs are
made: two fingerprints are within 2 bits of each other exactly if both are within 1 bit of a common word, so each class of a shared
key is sent to itself and its neighbours at 1 bit (within the bits that the table drops, as the others are equal), and classes that
meet at such a word are linked to the smallest of them. A word is within 1 bit of at most 65 fingerprints, so no group is large. For
other radii, words within r // 2 bits are used if r is even; odd radii first use r + 1 and need a check of each pair, and aren't offered.

Cases: a text without words (null too) has fingerprint zero and is linked like any other; rows with a null doc_id get a fingerprint and
link others, and a component without any doc_id has a null id; repeated rows fall into one class; an empty table gives an empty
result; columns beyond doc_id and text are ignored by ``simhash_components`` and kept by ``dedup``;
very long texts are hashed in bounded steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.functions.graph import smallest_reachable
from quireworks.llm.common import save, settled

RADIUS = 2
SHINGLE = 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits that most of the text's word shingles set; 0 without words."""
    found = _WORD.findall((text or "").encode().lower())  # of bytes, lower() changes A-Z alone
    if not found:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) < shingle:
        hashes = np.array([digest(join(found), 42)], dtype=np.uint64)
    else:
        hashes = np.fromiter((digest(join(x), 42) for x in zip(*(found[i:] for i in range(shingle)), strict=False)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for long texts
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, "doc_id bigint, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that each table keeps."""
    vectors = 2 ** (radius + 1)
    given = [1 + i % (vectors - 1) for i in range(bits)]
    return [sum(1 << i for i, g in enumerate(given) if (g & v).bit_count() % 2) for v in range(1, vectors)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between the nodes of classes (node, fp; fp distinct) that connect all fingerprints within ``radius`` (2)."""
    if radius != 2:
        raise ValueError("links are made through words within 1 bit, which is radius 2")
    masks = covering_masks(radius)
    keyed = classes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    met = keyed.join(shared, ["t", "key"])
    flips = F.lit(None)
    for t, m in enumerate(masks):
        dropped = [F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]
        flips = F.when(F.col("t") == t, F.array(F.lit(0).cast("bigint"), *dropped)).otherwise(flips)
    # the table's bits are equal in all that share a key, so fp with a flip tells the key too
    near = met.select("node", "t", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    least = near.groupBy("t", "word").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(least, ["t", "word"]).where("a != node").select("a", F.col("node").alias("b")).distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row of ``docs`` (doc_id, text)."""
    fps = save(fingerprints(docs, shingle))
    classes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # nodes are fingerprints, as a class may have no doc_id and yet link others
    roots = smallest_reachable(fingerprint_links(classes.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = save(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = save(rooted.join(of_root, "root").select("fp", "component_id"))
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents of a component other than its smallest doc_id; rows without a doc_id stay."""
    gone = settled(docs.sparkSession, lambda: simhash_components(docs, radius, shingle).where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
