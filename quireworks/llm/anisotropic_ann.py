"""Approximate nearest neighbours for maximum inner product, by score-aware anisotropic quantisation.

A vector is cut into short pieces, each coded by one of 16 codewords (four bits). The loss that codewords and codes are chosen for
counts the part of the residual that is parallel to the vector more than the rest, since that part moves inner products with the
queries that score high. Codewords come from a bounded sample; every vector is encoded. A search adds up table entries over the codes,
two codes a look, keeps the best of each block of candidates, and ranks these again by exact inner products in double precision.

Candidates meet in blocks with blocks of queries, so a candidate is shuffled once for each query block, and work grows with queries times
candidates: no partition of directions is used to skip blocks, as on vectors without clusters it costs too much recall.

Equal vectors are one candidate with its smallest ids, so many copies neither crowd out others nor cost anything. Queries and candidates
meet in blocks of bounded size, each query block with each candidate block, and a block gives a few rows for each query.

Cases: vectors that are null, zero, of another than the commonest length, or hold null or non-finite components, and rows without an id
take no part, as queries or candidates; a repeated row counts once; ties go to smaller ids; with fewer candidates than asked for, all are
given; components may be of any numeric type; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import save

CODES = 16


@dataclass(frozen=True)
class Quantiser:
    """books: (pieces, 16, width); weight: how much more parallel residual error counts."""

    books: np.ndarray
    weight: float

    @property
    def dim(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def pieces(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.dim))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), self.books.shape[0], self.books.shape[2])

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes (rows, pieces), by coordinate descent on the anisotropic loss."""
        parts = self.pieces(x)
        unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        codes = np.zeros(parts.shape[:2], dtype=np.uint8)
        along = np.zeros(len(x))  # of the residual, over all pieces
        own = np.zeros(parts.shape[:2])
        for turn in range(rounds):
            for m, book in enumerate(self.books):
                rest = parts[:, m, None, :] - book[None]
                parallel = np.einsum("ncw,nw->nc", rest, unit[:, m])
                loss = (rest**2).sum(axis=2)
                if turn:
                    loss = loss + (self.weight - 1) * ((along - own[:, m])[:, None] + parallel) ** 2
                codes[:, m] = loss.argmin(axis=1)
                new = parallel[np.arange(len(x)), codes[:, m]]
                along += new - own[:, m]
                own[:, m] = new
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, pairs of pieces, 256): what two codes in a byte add to the inner product."""
        t = np.einsum("qmw,mcw->qmc", self.pieces(q), self.books).astype(np.float32)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES)


def train(sample: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6) -> Quantiser:
    """Codewords for ``sample``; ``threshold`` is the cosine from which on inner products matter, which sets the weight."""
    dim = sample.shape[1]
    count = math.ceil(dim / width)
    count += count % 2
    weight = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    books = np.zeros((count, CODES, width))
    model = Quantiser(books, weight)
    parts = model.pieces(sample)
    if not len(sample):
        return model
    picks = np.linspace(0, len(sample) - 1, CODES).round().astype(int)
    for m in range(count):
        order = np.lexsort(parts[:, m].T)
        books[m] = parts[order[picks], m]
        for _ in range(rounds):  # plain k-means to begin with
            near = ((parts[:, m, None] - books[m][None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(CODES):
                if (mine := near == c).any():
                    books[m, c] = parts[mine, m].mean(axis=0)
    unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
    for _ in range(2):
        codes = model.encode(sample)
        rest = parts - books[np.arange(count), codes]
        own = (rest * unit).sum(axis=2)
        along = own.sum(axis=1)
        for m in range(count):
            for c in range(CODES):
                mine = codes[:, m] == c
                if mine.any():
                    u, x = unit[mine, m], parts[mine, m]
                    left = mine.sum() * np.eye(width) + (weight - 1) * u.T @ u
                    right = x.sum(axis=0) + (weight - 1) * (u * ((along - own[:, m])[mine] + (u * x).sum(axis=1))[:, None]).sum(axis=0)
                    books[m, c] = np.linalg.solve(left, right)
    return model


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products over the last axis in double precision, added in the order of the components."""
    total = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for d in range(q.shape[-1]):
        total += q[..., d] * x[..., d]
    return total


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = 20_000, block: int = 8192, query_block: int = 4096, rerank: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest others found for each row of vectors (vec_id, embedding) that ``is_query``.

    At most about ``sample`` vectors, chosen by a hash, train the codewords. In each block of at most about ``block`` candidates, the
    ``rerank`` best by table are ranked exactly: enough of a full block that some 0.99 of the true neighbours are among them.
    """
    spark = vectors.sparkSession
    sound = vectors.where("vec_id IS NOT NULL").where(_sound(F.col("embedding"))).select(F.col("vec_id").cast("bigint"), "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = save(sound)
    size = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = size["dim"] if size else 1
    rows = rows.where(F.size("embedding") == dim)
    # copies: the smallest ids of a vector are all that a result can hold; limited before the shuffle, and by salt
    few = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    salted = rows.select("vec_id", "embedding").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32))).withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    some = Window.partitionBy("embedding").orderBy("vec_id")
    least = salted.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k + 1)
    classes = save(least.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = classes.count()
    part = 1 << 30
    chosen = classes.where(F.pmod(F.xxhash64("cid", F.lit(6)), F.lit(part)) * F.lit(max(n, 1)) < F.lit(part * min(sample, max(n, 1)))).select("cid", "embedding").toPandas().sort_values("cid")
    model = train(np.array(chosen["embedding"].tolist(), dtype=float).reshape(-1, dim))

    def code(batches):
        for batch in batches:
            codes = model.encode(_matrix(pa.chunked_array([batch.column("embedding")]))) if batch.num_rows else np.zeros((0, 2), dtype=np.uint8)
            both = (codes[:, 0::2] * CODES + codes[:, 1::2]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("embedding"), batch.column("ids"), pa.array([r.tobytes() for r in both], pa.binary())], ["cid", "embedding", "ids", "codes"])

    coded = classes.mapInArrow(code, f"cid bigint, embedding {classes.schema['embedding'].dataType.simpleString()}, ids array<bigint>, codes binary")
    queries = save(rows.where("q").select("vec_id", "embedding").distinct().join(classes.select("embedding", "cid"), "embedding").select("vec_id", "cid", "embedding"))
    asked = save(queries.groupBy("cid").agg(F.min("embedding").alias("embedding")))
    n_blocks, n_asked = max(1, math.ceil(n / block)), asked.count()
    n_query_blocks = max(1, math.ceil(n_asked / query_block))
    numbered = lambda df, name, own, count, other, others: df.withColumn(own, F.pmod(F.xxhash64("cid", F.lit(name)), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = numbered(asked.select("cid", "embedding"), 1, "qb", n_query_blocks, "cb", n_blocks)
    right = numbered(coded, 2, "cb", n_blocks, "qb", n_query_blocks)

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and c.num_rows:
            q, c = q.sort_by("cid"), c.sort_by("cid")
            names, ids = q.column("cid").to_numpy(), c.column("ids").to_pylist()
            asked_of, held = _matrix(q.column("embedding")), _matrix(c.column("embedding"))
            codes = np.ascontiguousarray(np.frombuffer(b"".join(c.column("codes").to_pylist()), dtype=np.uint8).reshape(len(held), -1).T)
            top = min(rerank, len(held))
            for at in range(0, len(names), 128):
                some = asked_of[at : at + 128]
                best = np.empty((len(some), top), dtype=np.int64)
                for i, table in enumerate(model.tables(some)):
                    total = table[0][codes[0]]
                    for p in range(1, len(codes)):
                        total += table[p][codes[p]]
                    best[i] = np.argpartition(-total, top - 1)[:top]
                scores = exact(some[:, None, :], held[best])
                for i, name in enumerate(names[at : at + 128]):
                    pairs = [(-s, v) for s, b in zip(scores[i].tolist(), best[i].tolist(), strict=True) for v in ids[b]]
                    out += [(name, v, -s) for s, v in sorted(pairs)[: k + 1]]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["cid", "near", "score"])

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(search, "cid bigint, near bigint, score double")
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "near")
    best = save(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"))
    lists = best.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "near"))).alias("l"))  # k + 1 at most
    given = queries.join(lists, "cid").select("vec_id", F.posexplode(F.slice(F.filter("l", lambda x: x["near"] != F.col("vec_id")), 1, k)).alias("i", "x"))
    return given.select(F.col("vec_id").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("x.near").alias("vec_id"), (-F.col("x.s")).alias("score"))
