"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Every statement here is a DataFrame expression. A text gives six transformed statistics (word length, symbols, repeated lines,
repeated eight-word windows, length, capitals and exclamation marks). Per language and source, deterministic elemental starts are improved by concentration steps,
the start with the least determinant is improved further and reweighted, and texts far from it by Mahalanobis distance are rejected.

A concentration step is one aggregation: counts, sums and products by (group, start, distance bin), combined map-side. A group of any
size thus becomes some hundred rows before the shuffle, and the cut that holds a share of the group is found on these rows. Statistics
are whole multiples of 1/1024, so that sums don't depend on the order of rows and reruns agree.

Cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; groups of fewer than
``min_group`` rows are judged together with the other small groups of their language, and if these are still few, with all such rows;
repeated rows count as often as they occur and get the same verdict; an empty table gives an empty result; columns beyond
``doc_id, text, lang, source`` are ignored; of very long texts only the counts go on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import hinted, save, words

WINDOW = 8
UNIT = 1024
#: Standard deviations below which a statistic isn't told apart, in the order of ``_statistics``; added to the covariance.
FLOORS = (0.08, 0.35, 0.7, 0.7, 0.5, 0.3)
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
BINS_PER_OCTAVE = 8
#: Distances that one task works out; the table of statistics is so small that Spark would read it in few tasks.
TASK_DISTANCES = 100_000


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    for n in range(1, 500):
        term *= x / (a + n)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_cdf(x: float, df: int) -> float:
    return _gamma_p(df / 2, x / 2) if x > 0 else 0.0


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """By how much the covariance of the innermost share of a normal sample must be stretched."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"), (F.size(F.split(text, "[!A-Z]", -1)) - 1).cast("long").alias("n_loud"))
    n = F.size("w")
    window = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])
    # a window found twice needs one word more than a window
    hashed = base.withColumn("h", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    hashed = hashed.select("doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", "n_loud", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    # in order of hash and place, equal windows stand side by side
    pairs = hashed.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: x["h"].eqNullSafe(F.get("s", k)["h"])
    places = pairs.withColumn("at", F.when(F.col("again"), F.array_sort(F.transform(F.filter(F.transform("s", lambda x, k: F.struct(x["i"].alias("i"), (same(x, k - 1) | same(x, k + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"]
    return places.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_loud", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _statistics() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    x = (F.log(chars / n), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.log1p(100 * F.col("n_repeat_words") / n), F.log(n), F.log1p(100 * F.col("n_loud") / chars))
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(x)]


def _grouped(stats: DataFrame, min_group: int) -> DataFrame:
    """Adds ``grp``: language and source, or the pool that stands for small groups."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    lang, fine = name(F.col("lang")), F.concat(name(F.col("lang")), F.lit("\n"), name(F.col("source")))
    sizes = stats.groupBy(lang.alias("g_lang"), fine.alias("g_fine")).agg(F.count("*").alias("g_n"))
    small = F.col("g_n") < min_group
    pooled = sizes.groupBy("g_lang").agg(F.sum(F.when(small, F.col("g_n"))).alias("g_pool"))
    pool = F.when(F.col("g_pool") < min_group, F.lit("rest")).otherwise(F.concat(F.lit("pool\n"), F.col("g_lang")))
    groups = save(sizes.join(pooled, "g_lang").select("g_fine", F.when(small, pool).otherwise(F.concat(F.lit("group\n"), F.col("g_fine"))).alias("grp")))
    return stats.withColumn("g_fine", fine).join(hinted(groups, groups.count()), "g_fine").drop("g_fine")


def _cholesky(params: DataFrame) -> DataFrame:
    """From cov_i_j the lower factor l_i_j and the log of the determinant, column by column."""
    for j in range(P):
        inner = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"cov_{j}_{j}") - inner, F.lit(1e-9))))
        params = params.withColumns({f"l_{i}_{j}": (F.col(f"cov_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, P)})
    return params.withColumn("logdet", 2 * sum((F.log(f"l_{j}_{j}") for j in range(P)), F.lit(0.0)))


def _estimate(sums: DataFrame, keys: list[str], stretch: float) -> DataFrame:
    """Means and the factor of the covariance from n, s_i and q_i_j."""
    mean = {i: F.col(f"s_{i}") / F.col("n") / UNIT for i in range(P)}
    cov = {(i, j): F.greatest(F.col(f"q_{i}_{j}") / F.col("n") / UNIT**2 - mean[i] * mean[j], F.lit(0.0)) if i == j else F.col(f"q_{i}_{j}") / F.col("n") / UNIT**2 - mean[i] * mean[j] for i, j in PAIRS}
    params = sums.select(*keys, "total", *[mean[i].alias(f"m_{i}") for i in range(P)], *[(stretch * c + (F.lit(FLOORS[i] ** 2) if i == j else 0)).alias(f"cov_{i}_{j}") for (i, j), c in cov.items()])
    return _cholesky(params).select(*keys, "total", "logdet", *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in PAIRS])


def _distance(joined: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the squared Mahalanobis distance d2, by forward substitution, and drops the parameters."""
    for i in range(P):
        joined = joined.withColumn(f"y{i}", (F.col(f"x{i}") / UNIT - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return joined.select(*keep, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0)).alias("d2"))


_XS = [f"x{i}" for i in range(P)]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(_XS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q_{i}_{j}") for i, j in PAIRS]]


def _totals() -> list[Column]:
    names = ["n", *[f"s_{i}" for i in range(P)], *[f"q_{i}_{j}" for i, j in PAIRS]]
    return [F.sum(x).alias(x) for x in names]


def _spread(rows: DataFrame, distances: int) -> DataFrame:
    """``rows`` in as many tasks as the number of distances asks for, at some 60 bytes of shuffle a row, if these are more than cores."""
    parts = math.ceil(distances / TASK_DISTANCES)
    return rows.repartition(parts) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def _concentrate(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One concentration step: the estimate from the nearest ``share`` of each group, in whole distance bins."""
    by_bin = _distance(rows.join(params, "grp"), ["grp", "start", "total", *_XS]).withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1e-3))) * BINS_PER_OCTAVE)).groupBy("grp", "start", "total", "bin").agg(*_sums())
    needed = F.ceil(F.col("total") * share)
    # bounded: a group has at most as many bins as the distances have eighths of octaves
    cut = by_bin.groupBy("grp", "start").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    cut = cut.select("grp", "start", F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("cut")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.coalesce(a["cut"], F.when(a["n"] + b["n"] >= needed, b["bin"])).alias("cut")))["cut"].alias("cut"))
    near = by_bin.join(cut, ["grp", "start"]).where("bin <= cut")
    return _estimate(near.groupBy("grp", "start").agg(F.max("total").alias("total"), *_totals()), ["grp", "start"], consistency(share))


def mcd_outliers(docs: DataFrame, share: float = 0.75, starts: int = 6, early_steps: int = 2, late_steps: int = 3, reweight: float = 0.975, quantile: float = 1 - 1e-9, min_group: int = 60) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (null without words) and ``kept`` for each row of ``docs`` (doc_id, text, lang, source).

    ``share`` is the part of a group that the estimate rests on; ``quantile`` of the chi-squared distribution sets the distance
    beyond which a text is rejected. Texts that fail the base rules aren't part of the estimates.
    """
    stats = save(text_counts(docs).withColumn("base_failed", base_failed()).select("*", *_statistics()))
    rows = save(_grouped(stats, min_group))
    sound = rows.where("NOT base_failed")
    counts = save(sound.groupBy("grp").agg(F.count("*").alias("total")))
    # elemental starts: about 2 P + 2 rows of a group, chosen by a hash
    sizes = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("rows")).first()
    n = sizes["n"]
    seeds = sound.join(hinted(counts, n), "grp").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).where(F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 30)) * F.col("total") <= F.lit((2 * P + 2) * (1 << 30)))
    params = save(_estimate(seeds.groupBy("grp", "start").agg(F.max("total").alias("total"), *_sums()), ["grp", "start"], 1.0))
    for _ in range(early_steps):
        params = save(_concentrate(_spread(sound, sizes["rows"] * starts), hinted(params, n * starts), share))
    best = params.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    params = save(params.join(best, ["grp", "start"]))
    for _ in range(late_steps):
        params = save(_concentrate(_spread(sound, sizes["rows"]), hinted(params, n), share))
    inner = _distance(sound.join(hinted(params, n), "grp"), ["grp", "start", "total", *_XS]).where(F.col("d2") <= chi2_quantile(reweight, P))
    final = save(_estimate(inner.groupBy("grp", "start").agg(F.max("total").alias("total"), *_sums()), ["grp", "start"], consistency(reweight)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _distance(rows.join(hinted(final, n), "grp", "left"), columns)
    far = F.col("d2") > chi2_quantile(quantile, P)
    return judged.select(*columns, (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), F.when(F.col("n_words") > 0, F.sqrt("d2")).alias("distance"))
