"""Quotations, phrases and retrieval in any script, against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import rows

from quireworks.functions import automaton, fingerprints
from quireworks.functions.text import UNSPACED
from quireworks.operators import index, validate

HAN = "河流志的旧版本东西很好我觉得这个"
MARKS = ["，", "。", "“", "”", " ", "\n", "'", '"', "-", "(", ")"]


def made_text(rng, n):
    words = [rng.choice(["the", "old", "bridge", "fell", "River", "é", "x1"]) if rng.random() < 0.5 else "".join(rng.choices(HAN, k=rng.randint(1, 6))) for _ in range(n)]
    return "".join(w + rng.choice([" ", "", *MARKS]) for w in words)


def test_fingerprints_are_shared():
    """Whatever 32 characters two texts share, a fingerprint of one is one of the other."""
    rng = random.Random(3)
    for _ in range(100):
        piece = made_text(rng, 40)[: rng.randint(32, 90)]
        if len(piece) < 32:
            continue
        whole = made_text(rng, rng.randint(0, 60)) + piece + made_text(rng, rng.randint(0, 60))
        assert set(fingerprints.keys(piece, 32)) <= set(fingerprints.keys(whole, 32))
        size, key = fingerprints.key_of(piece[: rng.randint(1, 60)])
        assert key in fingerprints.keys(whole, size)
    h = np.array([5, 3, 9, 1, 7, 7, 2], dtype=np.uint64)
    for width in range(1, 8):
        assert list(fingerprints._least(h, width)) == [min(h[i : i + width]) for i in range(len(h) - width + 1)]
    assert len(fingerprints.keys("", 1)) == 0 and len(fingerprints.keys("ab", 32)) == 0


def test_quotes_are_found_as_contains_finds_them(spark):
    rng = random.Random(7)
    bodies = [(i, i % 3, made_text(rng, rng.randint(1, 80))) for i in range(40)] + [(40, 0, ""), (41, 0, None), (42, 0, "x" * 70_000 + "河流志"), (None, 0, "河流志")]
    quotes = []
    for q in range(120):
        body = rng.choice(bodies[:40])[2]
        a, b = sorted(rng.randint(0, len(body)) for _ in range(2))
        quote = body[a:b][: rng.choice([3, 20, 200])]
        if rng.random() < 0.3:
            quote = quote[: len(quote) // 3] + rng.choice(["……", "…", "..."]) + quote[2 * len(quote) // 3 :]
        quotes.append((q, quote))
    quotes += [(900, "河流志的旧版本"), (901, "the old bridge fell"), (902, " …… "), (903, None), (904, "河流志"), (905, "x" * 33 + "...河")]
    bodies += [(50, 1, "他说：“河流志的旧版本”。"), (51, 1, 'He said "the old bridge fell" twice.')]
    found = validate.find_verbatim(spark.createDataFrame(quotes, "quote_id bigint, quote string"), spark.createDataFrame(bodies, "doc_id bigint, chunk_no bigint, body string"))

    def holds(body, quote):
        parts = [p for p in (x.strip() for x in re.split(r"……|…|\.\.\.", quote)) if p]
        at = 0
        for p in parts:
            at = body.find(p, at)
            if at < 0:
                return False
            at += len(p)
        return bool(parts)

    want = {(q, d, c) for q, quote in quotes if quote for d, c, body in bodies if body and d is not None and holds(body, quote)}
    assert (900, 50, 1) in want and (901, 51, 1) in want and (904, 42, 0) in want and (905, 42, 0) in want
    assert set(rows(found)) == want
    nothing = validate.find_verbatim(spark.createDataFrame([], "quote_id bigint, quote string"), spark.createDataFrame(bodies, "doc_id bigint, chunk_no bigint, body string"))
    assert nothing.count() == 0


LINES = [
    (1, 1, "我觉得这个东西很好"), (1, 2, "东，西 isn't 东西"), (1, 3, "Of  the, bridge"), (1, 4, None), (2, 1, "other the isle of them"), (2, 2, "用python写 PYTHON3 und Python"), (2, 3, ""), (None, 1, "this is it"), (3, 7, "T恤和t恤 at恤"), (3, 2, "café cafe"),
]
PHRASES = ["东西", "of the", "the", "is", "python", "t恤", "好", "cafe", "东", "isn't", "of the bridge", "很", "觉得这个东西很"]


def stands(line, phrase):
    """By a regular expression with edges at letters of spaced scripts."""
    letter = rf"(?:(?![{UNSPACED}])[\w'́])"
    flat = lambda x: re.sub(r"[^\w'́]+|_", " ", x.lower()).strip()
    edge = lambda c, look: look if re.match(letter, c) else ""
    p = flat(phrase)
    return re.search(edge(p[0], f"(?<!{letter})") + re.escape(p) + edge(p[-1], f"(?!{letter})"), flat(line)) is not None


@pytest.mark.parametrize("most", [0, 1000])
def test_phrases(spark, most):
    lines, phrases = spark.createDataFrame(LINES, "doc_id bigint, line_no int, line string"), spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    want = {(d, n, p) for d, n, line in LINES if line for p in PHRASES if stands(line, p)}
    if not most:
        want = {x for x in want if x[0] is not None}  # a line is told by its numbers
    assert (1, 1, "东西") in want and (1, 2, "isn't") in want and (2, 2, "python") in want and (2, 1, "the") in want and (2, 1, "of the") not in want and (3, 7, "t恤") in want
    found = automaton.phrases_in(lines, phrases, most=most)
    assert set(rows(found, "doc_id", "line_no", "phrase")) == want and found.count() == len(want)
    first = {(d, p): min(n for e, n, q in want if (e, q) == (d, p)) for d, _, p in want}
    some = automaton.phrases_in(lines, phrases, True, most)
    by = {}
    for d, n, p in rows(some, "doc_id", "line_no", "phrase"):
        by.setdefault((d, p), []).append(n)
    assert {k: min(v) for k, v in by.items()} == first
    assert automaton.phrases_in(lines, phrases.where("false"), most=most).count() == 0


def test_terms_of_drafts(spark):
    lines = spark.createDataFrame(LINES, "doc_id bigint, line_no int, line string")
    terms = spark.createDataFrame([("thing", "东西"), ("thing", "东"), ("lang", "Python"), ("lang", "t恤")], "term string, translation string")
    assert rows(validate.term_variants(lines, terms)) == [(1, "thing", "东,东西")]
    uses = spark.createDataFrame([("python", "用"), ("东西", "thing"), ("t恤", "T恤")], "word string, original string")
    assert rows(validate.first_use(lines, uses)) == [(1, "东西", 1)]


@pytest.mark.parametrize("common", [0.0, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("by_rarity", [False, True])
def test_retrieval_equals_full_scoring(spark, common, by_rarity):
    rng = random.Random(13)
    said = lambda n: " ".join(rng.choice(["common", "often", "rare%d" % rng.randint(0, 30), "many%d" % rng.randint(0, 4), "河流志的旧版", "旧版", "志"]) for _ in range(n))
    chunks = [(i // 3, i % 3, said(rng.randint(0, 8)), [said(2)], ["common"]) for i in range(150)] + [(None, 1, "rare1", [], [])]
    queries = [(q, said(rng.randint(0, 6))) for q in range(25)] + [(30, "common"), (31, "nowhere"), (32, None), (33, "河流志 rare1")]

    def terms(text):
        han = f"[{UNSPACED}]+"
        out = {w for w in re.split(r"[\W_]+", re.sub(han, " ", (text or "").lower())) if len(w) > 2}
        for r in re.findall(han, text or ""):
            out |= {r} if len(r) == 1 else {r[k : k + 2] for k in range(len(r) - 1)}
        return out

    held = {(d, c): terms(" ".join([m, *s, *t])) for d, c, m, s, t in chunks if d is not None}
    df = {t: sum(t in h for h in held.values()) for t in set().union(*held.values())}
    weight = {t: (len(held) // n).bit_length() if by_rarity else 1 for t, n in df.items()}
    want = []
    for q, text in queries:
        scores = sorted((-sum(weight[t] for t in terms(text) & h), k) for k, h in held.items() if terms(text) & h)
        want += [(q, r, *k, -s) for r, (s, k) in enumerate(scores[:5], 1)]
    described = spark.createDataFrame(chunks, "doc_id bigint, chunk_no bigint, main string, subtopics array<string>, tags array<string>")
    found = index.retrieve(spark.createDataFrame(queries, "query_id bigint, text string"), described, 5, by_rarity=by_rarity, common=common)
    assert rows(found, "query_id", "rank", "doc_id", "chunk_no", "score") == sorted(want, key=repr)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
