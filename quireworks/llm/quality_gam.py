"""Quality classifier: a generalised additive model with pairwise interactions, of lookup tables.

Features are figures of a text alone. Each is cut into at most ``bins`` bins at quantiles of the training rows. Boosting goes round the
features: in each turn a shallow tree on one feature, fitted to the gradient of the log loss, adds to that feature's table at a small
rate. When the single tables are done, pairs are ranked by how much of the rest a grid over the two explains, and the best ones are
boosted in turn as tables over both. A score is the sum of a few table entries, looked up for whole batches at once.

Training rows: labels whose ``crc32(doc_id as text) % 5`` isn't 0, at most about ``max_rows`` of them, chosen by a hash of doc_id. The
bound makes what the driver sees independent of the corpus.

Cases: null and empty texts have the figures of the empty text and are scored; a null quality or doc_id among the labels is left out,
and so are repeated labels that contradict each other; without labels of both kinds every score is the share of 1 (0.5 without any);
repeated rows score alike; an empty table gives an empty result; ``score`` ignores columns beyond doc_id and text, ``keep`` keeps them;
figures are of whole texts, however long.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


THRESHOLD = 0.3
MAX_ROWS = 20_000
FEATURES = ("log_words", "word_length", "capitals", "digits", "symbols", "marks", "exclamation", "pipes", "spaces", "other_bytes", "line_words", "repeated_lines", "distinct_words", "top_word", "same_as_next", "long_words", "line_pipes", "line_exclamation", "line_symbols", "line_sameness")

_CLASSES = np.zeros(256, dtype=np.uint8)
for _c, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+\\/{}[]", b".,;:?'\"()-", b"!", b"|", b" \t\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _CLASSES[list(_chars)] = _c


def figures(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``."""
    text = text or ""
    data = text.encode()
    n = max(1, len(data))
    shares = np.bincount(_CLASSES[np.frombuffer(data, dtype=np.uint8)], minlength=9)[1:9] / n
    words = text.split()
    n_words = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    counts = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    # of junk within one line of a clean text, shares of the whole text show little
    worst = [0.0, 0.0, 0.0, 0.0]
    for line in lines:
        w = line.split()
        k = len(w)
        if k >= 5:
            count = line.count
            worst = list(map(max, worst, (count("|") / k, count("!") / k, sum(map(count, "#$%&*")) / k, 1 - len(set(w)) / k**0.9 if k > 9 else 0.0)))
    return [np.log1p(len(words)), sum(map(len, words)) / n_words, shares[0], shares[1], shares[2], shares[3], shares[4], shares[5], shares[6], shares[7], np.log1p(n_words / n_lines), 1 - len(set(lines)) / n_lines if lines else 0.0, len(counts) / n_words**0.9, max(counts.values(), default=0) / n_words, same / n_words, sum(len(w) > 14 for w in words) / n_words, *worst]


@dataclass
class Model:
    """Edges of the bins, a table for each feature and for each pair, and the intercept."""

    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, table in enumerate(self.single):
            total += table[b[:, i]]
        for (i, j), table in zip(self.pairs, self.double, strict=True):
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Steps of a tree with at most ``leaves`` leaves over ordered bins, from sums of gradients and curvatures by bin."""
    gain = lambda a, b: a * a / (b + ridge)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            won = gain(cg[at] - cg[a], ch[at] - ch[a]) + gain(cg[b] - cg[at], ch[b] - ch[at]) - gain(cg[b] - cg[a], ch[b] - ch[a])
            if won.max() > best[0]:
                best = (won.max(), k, int(at[won.argmax()]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Steps of a tree of two splits over a table: the best cut of one axis, then the best cut of the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, a.shape[0]):
            steps, won = np.zeros_like(a), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                cg, ch = np.cumsum(a[rows].sum(axis=0)), np.cumsum(b[rows].sum(axis=0))
                gains = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
                at = int(gains.argmax()) + 1 if len(gains) else len(cg)
                won += gains.max() if len(gains) else cg[-1] ** 2 / (ch[-1] + ridge)
                steps[rows, :at] = cg[at - 1] / (ch[at - 1] + ridge)
                if at < len(cg):
                    steps[rows, at:] = (cg[-1] - cg[at - 1]) / (ch[-1] - ch[at - 1] + ridge)
            if won > best:
                best, out = won, steps.T if turned else steps
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 25, ridge: float = 5.0) -> Model:
    """The model of rows ``x`` (figures) and ``y`` (0 or 1)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(len(FEATURES))]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], intercept=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.single):
            g, h = gradient()
            n = len(table)
            step = rate * _tree(np.bincount(b[:, i], g, n), np.bincount(b[:, i], h, n), leaves, ridge)
            table += step
            total += step[b[:, i]]

    g, h = gradient()
    ranked = []
    for i, j in itertools.combinations(range(len(edges)), 2):
        shape = len(model.single[i]), len(model.single[j])
        if min(shape) > 1:
            at = b[:, i] * shape[1] + b[:, j]
            cell_g, cell_h = np.bincount(at, g, shape[0] * shape[1]), np.bincount(at, h, shape[0] * shape[1])
            ranked.append((-float((cell_g**2 / (cell_h + ridge)).sum()), i, j))
    for _, i, j in sorted(ranked)[:n_pairs]:
        model.pairs.append((i, j))
        model.double.append(np.zeros((len(model.single[i]), len(model.single[j]))))
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.double, strict=True):
            g, h = gradient()
            at = b[:, i] * table.shape[1] + b[:, j]
            step = rate * _grid(np.bincount(at, g, table.size).reshape(table.shape), np.bincount(at, h, table.size).reshape(table.shape), ridge)
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _figures_of(texts) -> np.ndarray:
    return np.array([figures(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **settings) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), never of rows held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    n = known.count()
    part = 1 << 30
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(part)) * F.lit(max(n, 1)) < F.lit(part * min(max_rows, max(n, 1)))).select("doc_id", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _figures_of(t.as_py() for t in batch.column("text"))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(flat, len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # chosen is bounded by max_rows, some twenty bytes a row
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(y AS int) AS y", "text")
    # repeated documents count once, with the least of their texts, and the order is that of doc_id
    once = joined.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = once.mapInArrow(work, "doc_id bigint, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(dtype=float), **settings)


def score_column(model: Model) -> object:
    """A function of a text column that gives its score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [model.score(_figures_of(t.as_py() for t in texts.slice(at, 1024))) for at in range(0, len(texts), 1024)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    scored = docs.select("doc_id", score_column(model)("text").alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    return docs.where(score_column(model)(F.col("text")) >= threshold)
