"""The ten operators against brute force, and on odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA, rows, same_rows

from quireworks.functions import graph
from quireworks.llm import anisotropic_ann, bpe_stream, license_templates, outliers, quality_gam, queries, simhash, source_mix, token_rollups, url_cascade

DOCS = "doc_id bigint, text string, lang string, source string, words string, size int, taken int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", "x", 1, 1), (2, "", "en", "a", "x", 1, 1), (3, " \n\t ", None, None, None, None, None), (4, "one", "en", None, "x", 1, 1), (5, LONG, "en", "a", "x", 1, 1),
    (6, "same words in here\nsame words in here", "en", "b", "x", 1, 1), (6, "same words in here\nsame words in here", "en", "b", "x", 1, 1), (7, "ünï \u00a0 cödé #$%&|<>", "fr", "a", "x", 1, 1), (None, "no id at all", "en", "a", "x", 1, 1), (8, "x " * 40, "en", "a", "x", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, str(DATA)), duck, queries.oracle_sql()[name])


# 1


def counts_by_loop(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd, docs):
    for table in (odd, docs):
        texts = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        want = sorted(((i, *counts_by_loop(t)) for i, t in texts), key=repr)
        assert rows(outliers.text_counts(table), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


def test_outliers(spark, odd, nothing, docs):
    assert outliers.mcd_outliers(nothing).count() == 0
    found = {r.doc_id: r for r in outliers.mcd_outliers(odd).collect()}
    assert len(found) == len(ODD) - 1
    assert found[1].base_failed and not found[1].kept and found[8].base_failed
    rng = random.Random(5)
    clean = [(i, " ".join("abcdefghij"[: rng.randint(2, 9)] for _ in range(rng.randint(60, 400))), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join("ab###$$$%%%" for _ in range(100)) + str(i), "en", "a") for i in range(30)]
    table = spark.createDataFrame([(i, " ".join(f"{w}{k % 97}" for k, w in enumerate(t.split())), la, s) for i, t, la, s in clean + junk], "doc_id bigint, text string, lang string, source string")
    first = rows(outliers.mcd_outliers(table))
    kept = {r[0]: (r[7], r[6]) for r in first}
    assert all(kept[i][0] for i in range(300) if not kept[i][1])
    assert not any(kept[1000 + i][0] for i in range(30))
    assert rows(outliers.mcd_outliers(table)) == first


def mcd_by_loop(x, starts, share=0.75, reweight=0.975):
    """Squared distances of the rows of ``x`` by plain concentration steps; starts are index arrays."""

    def estimate(rows, stretch):
        mean = rows.mean(axis=0)
        return mean, stretch * ((rows - mean).T @ (rows - mean)) / len(rows) + np.diag(np.square(outliers.FLOORS))

    def distances(mean, cov):
        return np.array([(r - mean) @ np.linalg.solve(cov, r - mean) for r in x])

    def step(mean, cov):
        bins = np.floor(np.log2(np.maximum(distances(mean, cov), 1e-3)) * outliers.BINS_PER_OCTAVE)
        cut = np.sort(bins)[math.ceil(len(x) * share) - 1]
        return estimate(x[bins <= cut], outliers.consistency(share))

    det = lambda p: np.linalg.slogdet(p[1])[1]
    tried = [estimate(x[s], 1.0) for s in starts if len(s)]
    for _ in range(2):
        tried = [step(*p) for p in tried]
    best = min(tried, key=det)
    for _ in range(3):
        best = step(*best)
    return distances(*estimate(x[distances(*best) <= outliers.chi2_quantile(reweight, outliers.P)], outliers.consistency(reweight)))


def test_distances_equal_plain_steps(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    shapes = [("en", "a", 200), ("fr", "b", 120), ("de", "a", 40), ("de", "b", 40), ("de", None, 5), (None, "a", 90)]

    def text(odd):
        n = rng.randint(30, 300)
        return " ".join(rng.choice("AbcdeFghij") * rng.randint(1, 9) + str(k % 89) + ("#$" if odd and rng.random() < 0.5 else "") for k in range(n)) + "\nline" * rng.randint(0, 6 if odd else 1)

    table, i = [], 0
    for lang, source, n in shapes:
        for k in range(n):
            table.append((i, text(k % 6 == 0), lang, source))
            i += 1
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.mcd_outliers(docs).collect()}
    stats = outliers.text_counts(docs).withColumn("bad", outliers.base_failed()).select("*", *outliers._statistics())
    for j in range(6):
        stats = stats.withColumn(f"h{j}", F.pmod(F.xxhash64("doc_id", F.lit(j)), F.lit(1 << 30)))
    held = stats.orderBy("doc_id").collect()
    rejected = 0
    for group in (["en"], ["fr"], ["de"], [None]):
        mine = [r for r in held if r.lang in group and not r.bad]
        x = np.array([[r[f"x{k}"] for k in range(outliers.P)] for r in mine]) / outliers.UNIT
        starts = [[k for k, r in enumerate(mine) if r[f"h{j}"] * len(mine) <= (2 * outliers.P + 2) * (1 << 30)] for j in range(6)]
        for r, d2 in zip(mine, mcd_by_loop(x, starts), strict=True):
            assert math.isclose(got[r.doc_id].distance, math.sqrt(d2), rel_tol=1e-6)
            assert got[r.doc_id].kept == (d2 <= outliers.chi2_quantile(1 - 1e-9, outliers.P))
            rejected += not got[r.doc_id].kept
    assert len(got) == len(table) and rejected > 0


def test_chi2():
    assert abs(outliers.chi2_cdf(outliers.chi2_quantile(0.975, 5), 5) - 0.975) < 1e-9
    assert abs(outliers.chi2_quantile(0.95, 1) - 3.841459) < 1e-5


# 2


def test_cascade_is_exact(spark):
    keys = spark.range(5000).selectExpr("CAST(id * 7919 AS string) AS key", "id % 9 = 0 AS listed")
    levels = url_cascade.build_cascade(keys)
    from pyspark.sql import functions as F

    assert keys.withColumn("found", url_cascade.in_cascade(levels, F.col("key"))).where("found != listed").count() == 0
    assert len(levels) > 1


def test_long_list(spark):
    """A million listed keys, as literals and, with filters bounded lower, by a join: the same exact verdicts."""
    from pyspark.sql import functions as F

    listed = spark.range(1_000_000).select(F.concat(F.lit("l"), F.col("id").cast("string"), F.lit(".example.org")).alias("key"))
    pages = spark.range(0, 1_200_000, 400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.l"), F.col("id").cast("string"), F.lit(".example.org/x")).alias("url")).unionByName(spark.createDataFrame([(5, None), (5, None), (0, "http://a.l0.example.org/x")], "page_id bigint, url string"))
    for most in (16 << 20, 4096):
        got = url_cascade.filter_urls(pages, listed, [], max_bytes=most).select("page_id", "verdict").collect()
        assert len(got) == 3003
        assert all((r.verdict == "block") == (r.page_id < 1_000_000 and r.page_id != 5) for r in got)


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Bad.com/x?y"), (5, "http://bad.com"), (6, "http://ok.org/bad.com"), (6, "http://ok.org/bad.com"), (7, "http://WWW.example.com/en/a#b"), (8, "http://example.com/en/"), (9, "x://y.net/es/q"), (10, "http://com?x"), (11, "http://sub.notbad.com"), (12, "http://one.org/p?q")], "page_id bigint, url string")
    listed = spark.createDataFrame([("bad.com",), ("one.org/p",), (None,)], "key string")
    got = {r.page_id: tuple(r)[1:] for r in url_cascade.filter_urls(pages, listed, queries.URL_RULES[1:]).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.bad.com", "/x", None, "block") and got[5][3] == "block" and got[6][3] == got[11][3] == "allow"
    assert got[7] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[8][2:] == ("example.com/en/", "block")
    assert got[9][2:] == ("net/es/", "block") and got[10] == ("com", "", None, "allow") and got[12][3] == "block"
    none = url_cascade.filter_urls(pages, listed.where("false"), queries.URL_RULES)
    assert none.where("rule IS NULL AND verdict = 'block'").count() == 0
    assert url_cascade.filter_urls(pages.where("false"), listed, queries.URL_RULES).count() == 0
    assert none.where("page_id = 5").first().rule is None and none.where("page_id = 4").first().rule == "com/"


# 3


def test_rollups(spark, docs, odd, nothing):
    counted = {(r.source, r.lang, r.tokenizer): r.n_tokens for r in queries.op3_token_rollups(spark, str(DATA)).collect()}
    want: Counter = Counter()
    encode = token_rollups._encoder(queries.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    for r in docs.collect():
        times = {3: 0, 7: 2}.get(r.doc_id % 10, 1)
        want[r.source, r.lang, "words"] += times * len(WORD.findall(r.text))
        want[r.source, r.lang, "byte_bpe_50k"] += times * len(encode(r.text))
    assert counted == {k: v for k, v in want.items() if v}
    assert {r.doc_id: r.n_tokens for r in token_rollups.word_counts(odd).collect()}[1] == 0
    assert token_rollups.word_counts(nothing).count() == 0


def test_batches_are_idempotent(spark, tmp_path):
    rollup = token_rollups.Rollup(spark, f"file://{tmp_path}/r")
    schema = "source string, lang string, tokenizer string, op string, n_tokens bigint, old_tokens bigint"
    assert rollup.totals().count() == 0
    assert rollup.apply(1, spark.createDataFrame([("a", "en", "t", "insert", 10, None), (None, None, "t", "insert", 5, None), ("a", "en", "t", "odd", 9, 9)], schema))
    assert not rollup.apply(1, spark.createDataFrame([("a", "en", "t", "insert", 10, None)], schema))
    assert rollup.apply(2, spark.createDataFrame([("a", "en", "t", "revise", 4, 10), (None, None, "t", "delete", None, 5)], schema))
    assert rollup.apply(3, spark.createDataFrame([], schema)) and rollup.committed(3)
    assert rows(rollup.totals()) == [("a", "en", "t", 1, 4)]
    assert rows(token_rollups.compact(rollup, f"file://{tmp_path}/s").totals()) == [("a", "en", "t", 1, 4)]


def test_batch_delivered_twice_at_once(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, op string, n_tokens bigint, old_tokens bigint"
    rollup = token_rollups.Rollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([("a", "en", "t", "insert", 10, None)], schema)

    def late(batch):
        """Another delivery of the batch commits while this one is being written."""
        assert token_rollups.Rollup(spark, rollup.path).apply(1, one)
        return deltas(batch)

    deltas = token_rollups.signed_deltas
    with pytest.MonkeyPatch.context() as patch:
        calls = []
        patch.setattr(token_rollups, "signed_deltas", lambda batch: deltas(batch) if calls or calls.append(1) else late(batch))
        assert not rollup.apply(1, one)
    assert rows(rollup.totals()) == [("a", "en", "t", 1, 10)]
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["batch_id=1"]


# 4


def test_targets():
    quota = source_mix.targets({"a": 10, "b": 100, "c": 100, None: 50})
    assert quota["a"] == 20 and math.isclose(sum(quota.values()), 390)
    assert all(v <= 2 * n + 1e-9 for v, n in zip(quota.values(), (10, 100, 100, 50), strict=True))
    assert source_mix.targets({}) == {}


def test_flow_is_cheapest():
    rng = random.Random(7)
    for _ in range(40):
        capacity = {("a",): rng.randint(0, 3), ("b",): rng.randint(0, 3), ("a", "b"): rng.randint(0, 3)}
        quota = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        flow = source_mix.route(capacity, quota, 2)
        price = lambda p, n: max(0, n - capacity[p])  # noqa: E731  a second use costs 1
        got = {s: sum(f.get(s, 0) for f in flow.values()) for s in quota}
        cost = sum(price(p, sum(flow[p].values())) for p in capacity)
        best = None
        for x, y, z, w in itertools.product(range(7), repeat=4):
            if x <= 2 * capacity["a",] and y <= 2 * capacity["b",] and z + w <= 2 * capacity["a", "b"] and x + z <= quota["a"] and y + w <= quota["b"]:
                found = (-(x + z + y + w), price(("a",), x) + price(("b",), y) + price(("a", "b"), z + w))
                best = found if best is None else min(best, found)
        assert (-sum(got.values()), cost) == best


def test_mix(spark, docs, odd, nothing):
    from pyspark.sql import functions as F

    got = queries.op4_source_mix(spark, str(DATA))
    table = got.collect()
    assert rows(got) == rows(queries.op4_source_mix(spark, str(DATA)))
    taken, longest = Counter(), Counter()
    for r in table:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source, r.target] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(n - t) <= longest[s] / 2 + 1 for (s, t), n in taken.items())
    sized = lambda d: d.select("doc_id", "source", F.array("source").alias("sources"), source_mix.size_of(F.col("text")).alias("size"))
    assert source_mix.mix_sizes(sized(nothing)).count() == 0 and source_mix.mix(nothing).count() == 0
    assert source_mix.mix_sizes(sized(odd)).count() == len(ODD)
    mixed = source_mix.mix(docs)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and {r.doc_id: r.taken // r.size for r in table if r.taken} == dict(times)
    assert source_mix.mix(odd).columns == odd.columns


def test_overlapping_sources(spark):
    sized = spark.createDataFrame([(i, "a" if i % 2 else "b", ["a", "b"] if i % 3 == 0 else ["a" if i % 2 else "b"], 10) for i in range(600)], "doc_id bigint, source string, sources array<string>, size bigint")
    member = {r.doc_id: set(r.sources) for r in sized.collect()}
    got = source_mix.mix_sizes(sized, weights=(5, 2), share=1.0).collect()
    target = {r.source: r.target for r in got}
    filled = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and (r.quota_source in member[r.doc_id] if r.taken else r.quota_source is None)
        filled[r.quota_source] += r.taken
    assert all(abs(filled[s] - t) <= 30 for s, t in target.items())
    # what the quota of a needs beyond its own documents comes from the shared ones
    assert {r.quota_source for r in got if len(member[r.doc_id]) == 2 and r.taken} >= {"a"}


# 5


def test_licenses(spark, docs, odd, nothing):
    def brute(text):
        w = [x for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return len(w), sorted(i for p in license_templates.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())

    texts = ["Released under the MIT-License; MIT\nlicense", "This work is licensed under the GNU General Public License, version 3.", "CC BY 4", "cc\x00by accby cc byx", "mit éLicense mit license", None, ""]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 10_000)), "doc_id bigint, text string")).unionByName(odd.selectExpr("doc_id + 20000 AS doc_id", "text"))
    given: dict = {}
    for r in table.collect():
        given.setdefault(r.doc_id, r.text)
    for r in license_templates.label(license_templates.scan(table)).collect():
        n, places = brute(given[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(places, default=None), max(places, default=None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert license_templates.scan(nothing).count() == 0


def test_whole_licences(spark):
    def plain(name, fill):
        """A licence's wording with markup replaced: optional parts kept, replaceable ones filled."""
        return re.sub(r" +", " ", re.sub(r"<<any \d+>>", fill, re.sub(r"<<optional>>|<<end>>", " ", license_templates.LICENCES[name])))

    texts, want = [], []
    for name in license_templates.LICENCES:
        whole = plain(name, "X")
        for text, found in ((whole.upper(), True), ("Before it. " + re.sub(r"(\w+) (\w+)", r"\1,\n  \2;", whole) + " (and after)", True), (whole.replace("software", "hardware"), False), (whole[: -len(whole) // 20], False), (whole.replace(" or ", " or not "), False)):
            texts.append(text)
            want.append((name, found))
    bare = re.sub(r"<<optional>>(?:(?!<<optional>>).)*?<<end>>", "", license_templates.LICENCES["mit-text"], flags=re.DOTALL)
    texts.append(re.sub(r"<<any \d+>>", "authors", bare))
    want.append(("mit-text", True))
    got = license_templates.label(license_templates.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).orderBy("doc_id").collect()
    for r, (name, found) in zip(got, want, strict=True):
        assert (name in r.labels.split(",")) == found and (r.score == 1.0) == found, (name, r)


def test_automata():
    a = license_templates.compile_template("a <<optional>>b <<optional>>c<<end>><<end>> <<any 2>> d")
    shape = re.compile(r"a( b( c)?)?( \w){0,2} d")
    for n in range(1, 7):
        for w in itertools.product("abcd", repeat=n):
            ends = [i for i in range(1, n + 1) if shape.fullmatch(" ".join(w[:i]))]
            assert a.match([x.encode() for x in w], 0) == max(ends, default=-1)
    for bad in ("<<optional>> x", "<<end>> x", "<<any 2>>"):
        with pytest.raises(ValueError):
            license_templates.compile_template(bad)


# 6


def test_neighbours(spark):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{DATA.parent}/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in table.collect()}
    ids = np.array(sorted(vectors))
    all_ = np.stack([vectors[i] for i in ids])
    got: dict = {}
    for r in anisotropic_ann.nearest(table, F.col("vec_id") % 20 == 0, block=64, query_block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert math.isclose(r.score, float(vectors[r.query_id] @ vectors[r.vec_id]), rel_tol=1e-12)
    hits = 0
    for q, found in got.items():
        order = sorted((-s, i) for s, i in zip((all_ @ vectors[q]).tolist(), ids.tolist(), strict=True) if i != q)[:20]
        assert len(found) == 20
        hits += len({i for _, i in order} & set(found))
    assert hits / (20 * len(got)) >= 0.95 and set(got) == {i for i in vectors if i % 20 == 0}


def test_recall_of_a_full_block(spark):
    """The registered query's own block and rerank, on one block that is full."""
    from pyspark.sql import functions as F

    held = np.stack([np.array(r.embedding, dtype=np.float32) for r in spark.read.parquet(f"{DATA.parent}/sf0.1/embeddings.parquet").collect()])
    rng = np.random.default_rng(8)
    x = held[rng.integers(0, len(held), 8192)] + rng.normal(0, 0.5 * held.std(), (8192, held.shape[1])).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got: dict = {}
    for r in anisotropic_ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(float)
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & found)
    assert len(got) == 410 and hits / (20 * len(got)) >= 0.95


def test_odd_vectors(spark):
    from pyspark.sql import functions as F

    schema = "vec_id bigint, embedding array<float>, label int"
    good = [(i, [1.0, float(i % 3)], 0) for i in range(60)]
    bad = [(100, None, 0), (120, [0.0, 0.0], 0), (140, [float("nan"), 1.0], 0), (160, [float("inf"), 1.0], 0), (180, [1.0, None], 0), (200, [1.0], 0), (None, [1.0, 1.0], 0), (0, [1.0, 0.0], 0)]
    got: dict = {}
    for r in anisotropic_ann.nearest(spark.createDataFrame(good + bad, schema), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    want = lambda q: sorted(((-(1.0 + (q % 3) * (i % 3)), i) for i in range(60) if i != q))[:20]
    assert all([(i, -s) for s, i in want(q)] == got[q] for q in got)
    assert anisotropic_ann.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    few = anisotropic_ann.nearest(spark.createDataFrame(good[:3], schema), F.col("vec_id") == 0)
    assert few.count() == 2


def test_recall_of_the_query(spark):
    """The registered query's own parameters on the table of sf0.1, and vectors of doubles."""
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{DATA.parent}/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in table.collect()}
    ids = np.array(sorted(x))
    all_ = np.stack([x[i] for i in ids])
    for vectors in (table, table.withColumn("embedding", F.col("embedding").cast("array<double>"))):
        got: dict = {}
        for r in anisotropic_ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q, found in got.items():
            scores = np.where(ids == q, -np.inf, all_ @ x[q])
            hits += len(set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()) & found)
        assert set(got) == {i for i in x if i % 20 == 0} and hits / (20 * len(got)) >= 0.95


# 7


def fingerprint_by_loop(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_loop(pairs):
    label = {i: i for i, _ in pairs}
    fps = dict(pairs)
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(fps), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
                changed = True
    return label


def test_masks_cover_every_pair():
    for r in (1, 2, 3):
        masks = simhash.covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for bits in itertools.combinations(range(0, 64, 3), r):
            d = sum(1 << b for b in bits)
            assert any(not d & m for m in masks)


def test_links(spark):
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(170):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            f ^= 1 << b
        fps.append(f)
    pairs = list({f: i for i, f in enumerate(fps)}.items())
    table = spark.createDataFrame([(i, simhash._signed(f)) for f, i in pairs], "node bigint, fp bigint")
    got = {r.node: r.root for r in graph.smallest_reachable(simhash.fingerprint_links(table)).collect()}
    want = components_by_loop([(i, f) for f, i in pairs])
    assert {i: got.get(i, i) for _, i in pairs} == want


def test_chain_of_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.smallest_reachable(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 601: 600}
    assert graph.smallest_reachable(edges.where("false")).count() == 0


def test_simhash(spark, docs, odd, nothing):
    for table in (docs.limit(200), odd.where("doc_id IS NOT NULL")):
        texts = {r.doc_id: r.text for r in table.collect()}
        fps = {i: fingerprint_by_loop(t) for i, t in texts.items()}
        label = components_by_loop(list(fps.items()))
        found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(table).collect()}
        assert found == {i: (f"{fps[i]:016x}", label[i]) for i in texts}
    assert simhash.simhash_components(nothing).count() == 0
    assert simhash.simhash_components(odd).count() == len(ODD)
    left = simhash.dedup(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {1, 4, 5, 6, 7, 8, None}


# 9


@pytest.fixture(scope="module")
def codec():
    return bpe_stream.codec(queries.tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_codec_equals_library(codec, library, docs):
    rng = random.Random(13)
    alphabets = ["abcdefghijklmnop", "aab", "ehtnors ", "é'ßs ÀİΣ\n!?#1234", "".join(map(chr, range(32, 0x500))), "aeiou thing <|endoftext|>", "中文 あ👍\u200b\u0085\x1c"]
    texts = ["".join(rng.choice(a) for _ in range(rng.choice((1, 5, 40, 700)))) for a in alphabets for _ in range(60)]
    texts += ["", "a" * 5000, "thing" * 900, "<|startoftext|><|endoftext|>", *(r.text for r in docs.collect())]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        ids, decoded = codec.both(t)
        assert array("I", ids).tolist() == e.ids
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == bpe_stream.decode(codec, e.ids)


def test_stream_holds_little(codec):
    machine = bpe_stream.Transducer(codec.merges, codec.transducer.look)
    held = 0
    for c in "ehtnorsthing" * 3000:
        machine.push(c)
        held = max(held, machine.held)
    assert held <= 2 * machine.every


def test_words_come_back(codec):
    for text in ("hello world 's 12", "naïve 中文 x"):
        words = bpe_stream._TOKEN.findall(text)
        assert bpe_stream.decode(codec, array("I", codec.encode(text)), words=True).split() == words
    machine = bpe_stream.Decoder(codec, words=True)
    assert machine.push(codec.merges.ids[codec.merges.number[codec.symbols[0xC3]]]) == ""


def test_small_merges():
    """Lookahead bounds what is held, and every prefix stream equals plain merging."""
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "d"), ("abc", "abc"), ("d", "a")]
    names = ["a", "b", "c", "d", *[a + b for a, b in merges]]
    m = bpe_stream.Merges({t: i for i, t in enumerate(names)}, merges, {})
    rank = {p: i for i, p in enumerate(merges)}

    def plain(s):
        s = list(s)
        while True:
            found = [(rank[p], i) for i, p in enumerate(itertools.pairwise(s)) if p in rank]
            if not found:
                return s
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    for n in range(1, 8):
        for w in itertools.product("abcd", repeat=n):
            machine = bpe_stream.Transducer(m, m.lookahead())
            out = [t for c in w for t in machine.push(c)] + machine.finish()
            assert [m.names[t] for t in out] == plain(w)
    with pytest.raises(ValueError):
        bpe_stream.Merges({"a": 0, "b": 1, "ab": 2}, [("a", "x")], {})


def test_runs_equal_the_stream(codec, docs):
    """Short words at once, and letter by letter."""
    rng = random.Random(17)
    machine = bpe_stream.Transducer(codec.merges, codec.transducer.look)
    words = {w for r in docs.limit(40).collect() for w in bpe_stream._TOKEN.findall((r.text or "").lower())} | {"".join(rng.choice("etaoinshrdlu'") for _ in range(rng.randint(1, 60))) for _ in range(400)}
    for w in words:
        letters = [codec.symbols[b] for b in w.encode()]
        if len(letters) <= 64:
            slow = [t for c in letters[:-1] for t in machine.push(c)] + machine.push(letters[-1] + bpe_stream.END) + machine.finish()
            assert machine.run("".join(letters)) == slow


def test_streams_join(codec, docs, monkeypatch):
    monkeypatch.setattr(bpe_stream, "STREAM_WORDS", 7)
    for text in [None, "", "one", LONG[:5000], *(r.text for r in docs.limit(30).collect())]:
        parts = list(codec.stream(text))
        assert (b"".join(a for a, _ in parts), "".join(b for _, b in parts)) == codec.both(text)


def test_encode_table(spark, odd, nothing, codec):
    path = queries.tokenizer_path("word_bpe_49k.json")
    for r in bpe_stream.encode(odd, path).collect():
        assert r.n_tokens == len(r.ids)
    got = {r.doc_id: r for r in bpe_stream.digests(odd, path).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == got[2].ids_sha256
    assert bpe_stream.digests(nothing, path).count() == 0 and bpe_stream.encode(nothing, path).count() == 0


# 10


def test_classifier(spark):
    sf = str(DATA.parent / "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_quality_gam(spark, sf).collect()}
    held = [r for i, r in got.items() if r.held_out and i in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_classifier_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (4, 0, 0), (4, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_gam.train(odd, labels)
    assert quality_gam.score(odd, model).count() == len(ODD) and quality_gam.score(nothing, model).count() == 0
    assert quality_gam.keep(odd, model).columns == odd.columns
    none = quality_gam.train(odd, labels.where("false"))
    assert {r.score for r in quality_gam.score(odd, none).collect()} == {0.5}
    assert quality_gam.train(nothing, labels).intercept == 0


def test_scores_equal_plain_sums():
    rng = np.random.default_rng(4)
    x = rng.random((900, len(quality_gam.FEATURES)))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20, pair_rounds=5)
    odd = np.vstack([x[:50], np.full((1, x.shape[1]), -9.0), np.full((1, x.shape[1]), 9.0), [[float(e[0]) if len(e) else 0.0 for e in model.edges]]])
    for row, got in zip(odd, model.score(odd), strict=True):
        place = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, row, strict=True)]
        total = model.intercept + sum(t[place[i]] for i, t in enumerate(model.single)) + sum(t[place[i]][place[j]] for (i, j), t in zip(model.pairs, model.double, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-12)
    assert model.pairs


def test_trees_equal_search():
    """A tree's split and a grid's splits against every possible one."""
    rng = np.random.default_rng(5)
    ridge = 5.0
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + ridge)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9)
        cut = max(range(1, 9), key=lambda c: gain(g[:c], h[:c]) + gain(g[c:], h[c:]))
        want = np.concatenate([np.full(cut, g[:cut].sum() / (h[:cut].sum() + ridge)), np.full(9 - cut, g[cut:].sum() / (h[cut:].sum() + ridge))])
        if gain(g[:cut], h[:cut]) + gain(g[cut:], h[cut:]) > gain(g, h) + 1e-9:
            assert np.allclose(quality_gam._tree(g, h, 2, ridge), want)
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
        won = lambda parts: sum(gain(g[p], h[p]) for p in parts)
        tried = [[np.s_[:a, :b], np.s_[:a, b:], np.s_[a:, :c], np.s_[a:, c:]] for a in range(1, 4) for b in range(1, 5) for c in range(1, 5)]
        tried += [[np.s_[:b, :a], np.s_[b:, :a], np.s_[:c, a:], np.s_[c:, a:]] for a in range(1, 5) for b in range(1, 4) for c in range(1, 4)]
        best = max(tried, key=won)
        want = np.zeros_like(g)
        for p in best:
            want[p] = g[p].sum() / (h[p].sum() + ridge)
        assert np.allclose(quality_gam._grid(g, h, ridge), want)


def test_pairs_are_learned():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
