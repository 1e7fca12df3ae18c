from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import DATA

import corpus_pipeline
from quireworks.llm import line_dedup as ld

WORD = re.compile(r"[^\x20\x09-\x0D。！？；：，、]*[。！？；：，、]+|[^\x20\x09-\x0D。！？；：，、]+")
CLOSING = "\"'”’»)]"


def units_by_loop(text):
    """(start, end, normal form, words, letters) of each unit, word by word."""
    out = []
    tokens = []
    for line_no, line in enumerate(re.finditer(r"[^\n]*", text)):
        for m in WORD.finditer(line[0]):
            normal = "".join(c.lower() if len(c.lower()) == 1 else c for c in m[0])
            if any(c.isalnum() for c in normal):
                tokens.append((line.start() + m.start(), line.start() + m.end(), m[0], re.sub(r"[\W_]+", " ", normal).strip(), line_no))
    check = lambda ts: sum(ord(c) for t in ts for c in t[3] if c != " ")
    last = lambda t: t[2][-2] if t[2][-1] in CLOSING and len(t[2]) > 1 else t[2][-1]
    ends_line = [k + 1 == len(tokens) or tokens[k + 1][4] != t[4] for k, t in enumerate(tokens)]
    sentence, piece, unit = [], [], []
    for k, t in enumerate(tokens):
        sentence.append(k)
        if not (ends_line[k] or last(t) in ".!?;:…。！？；："):
            continue
        for i in sentence:
            piece.append(i)
            if i == sentence[-1] or len(sentence) > ld.LONG and (last(tokens[i]) in ",，、" or check([tokens[i]]) % ld.WORD_CUT == 0):
                unit += piece
                if ends_line[i] or len(piece) >= ld.SHORT or check([tokens[x] for x in piece]) % ld.PIECE_CUT == 0:
                    ts = [tokens[x] for x in unit]
                    out.append((ts[0][0], ts[-1][1], " ".join(x[3] for x in ts), len(ts), sum(len(x[3].replace(" ", "")) for x in ts)))
                    unit = []
                piece = []
        sentence = []
    return out


def stretches_by_loop(text, min_words=20, min_chars=200):
    """(start, end, normal form) of the shortest stretches that are long enough."""
    u = units_by_loop(text)
    enough = lambda i, j: sum(x[3] for x in u[i : j + 1]) >= min_words or sum(x[4] for x in u[i : j + 1]) >= min_chars
    found = set()
    for i in range(len(u)):
        found |= {(i, j) for j in [next((j for j in range(i, len(u)) if enough(i, j)), None)] if j is not None}
        found |= {(j, i) for j in [next((j for j in range(i, -1, -1) if enough(j, i)), None)] if j is not None}
    return [(u[i][0], u[j][1], " ".join(x[2] for x in u[i : j + 1])) for i, j in sorted(found)]


def repeats_by_loop(texts, min_words=20, min_chars=200):
    """Rows of ``repeated_passages`` without the tag, for texts by id."""
    first, places = {}, []
    for doc_id in sorted(texts):
        for start, end, n in sorted(stretches_by_loop(texts[doc_id] or "", min_words, min_chars)):
            places.append((doc_id, start, end, n))
            first.setdefault(n, (doc_id, start, end))
    spans = {}
    for doc_id, start, end, n in places:
        d, s, e = first[n]
        if (doc_id, start) > (d, s):
            begin = max(start, e) if d == doc_id else start
            if begin < end:
                spans.setdefault(doc_id, []).append((begin, end, d, s))
    out = []
    for doc_id, of_doc in spans.items():
        runs = []
        for span in sorted(of_doc):
            if runs and span[0] <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], span[1])
            else:
                runs.append(list(span))
        out += [(doc_id, b, e - b, d, s) for b, e, d, s in runs]
    return sorted(out)


def random_text(rng, words=400):
    marks = ["", "", "", "", ",", ".", "!", "…", '."', "?\n", "\n", " -- ", "。", "，", ";", ")"]
    return " ".join("".join(rng.choice("aBcÀß中1-_") for _ in range(rng.randint(1, 4))) + rng.choice(marks) for _ in range(rng.randrange(words)))


def test_stretches_equal_loop():
    rng = random.Random(4)
    texts = ["", " \n\t", "...", "中文没有空格，但是有标点。" * 30, "word " * 300, *(random_text(rng) for _ in range(120))]
    text, start, length, h1, h2 = ld.stretches(texts, 8, 40)
    got, names = {}, {}
    for t, s, n, a, b in zip(text.tolist(), start.tolist(), length.tolist(), h1.tolist(), h2.tolist(), strict=True):
        got.setdefault(t, []).append((s, s + n, (a, b)))
    for k, x in enumerate(texts):
        want = sorted(stretches_by_loop(x, 8, 40))
        assert [w[:2] for w in want] == [g[:2] for g in sorted(got.get(k, []))]
        for w, g in zip(want, sorted(got.get(k, [])), strict=True):
            assert names.setdefault(g[2], w[2]) == w[2]
    assert len(set(names.values())) == len(names)  # neither two forms of one digest, nor two digests of one form


def rows_of(docs, *bounds):
    return sorted(tuple(r)[:1] + tuple(r)[2:] for r in ld.repeated_passages(docs, *bounds).collect())


@pytest.mark.parametrize("bounds", [(20, 200), (5, 30)])
def test_repeated_passages(spark, bounds):
    rng = random.Random(9)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    assert rows_of(table, *bounds) == repeats_by_loop(texts, *bounds)
    shared = [random_text(rng) for _ in range(4)]
    mixed = {i: random_text(rng, 60) + rng.choice(shared) + rng.choice([" ", "\n", ", "]) + rng.choice(shared) + random_text(rng, 60) for i in range(60)} | {100: None, 101: "", 102: "one two"}
    docs = spark.createDataFrame([*mixed.items(), (7, mixed[7]), (None, mixed[8])], "doc_id bigint, text string")
    assert rows_of(docs, *bounds) == repeats_by_loop(mixed, *bounds)


def test_passages_of_table_are_caught(spark):
    """Stretches of 50 words that unlike texts share, junk apart: nearly all are found, and most of each goes."""
    texts = {}
    for r in spark.read.parquet(f"{DATA.parent}/sf0.01/documents.parquet").orderBy("doc_id").collect():
        texts.setdefault(r.text, r.doc_id)
    seen, met = {}, {}
    words = {i: list(re.finditer(r"\S+", t)) for t, i in texts.items()}
    sets = {i: {tuple(x[0] for x in w[k : k + 5]) for k in range(len(w))} for i, w in words.items()}
    for t, i in texts.items():
        for k in range(len(words[i]) - 49):
            window = tuple(x[0] for x in words[i][k : k + 50])
            if len(set(window)) > 20 and (j := seen.setdefault(window, i)) != i and len(sets[i] & sets[j]) < 0.3 * len(sets[i] | sets[j]):
                met.setdefault((i, j), []).append((words[i][k].start(), words[i][k + 49].end()))
    gone = {}
    docs = spark.createDataFrame([(i, t) for t, i in texts.items()], "doc_id bigint, text string")
    for r in ld.repeated_passages(docs).collect():
        gone.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    shares = []
    for (i, _), places in met.items():
        inside = np.zeros(max(e for _, e in places), dtype=bool)
        for s, e in places:
            inside[s:e] = True
        cut = np.zeros_like(inside)
        for s, e in gone.get(i, ()):
            cut[s:e] = True
        shares.append((inside & cut).sum() / inside.sum())
    assert len(shares) >= 2 and min(shares) > 0 and np.mean(shares) > 0.75


def test_planted_passages(spark):
    """A passage inside longer lines, one wrapped in short lines, and one without spaces go from all but the first document."""
    rng = random.Random(3)
    sentence = lambda n=12: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    inside, wrapped = " ".join(sentence() for _ in range(5)), "\n".join(sentence(9) for _ in range(6))
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(250)) + "。"
    own = [[sentence() for _ in range(6)] for _ in range(4)]
    short = "Yes, indeed."
    texts = [
        f"{own[0][0]} {own[0][1]} {inside} {own[0][2]}\n{short}\n{own[0][3]}\n{wrapped}\n{han}{own[0][4]}",
        f"{own[1][0]} {inside} {own[1][1]}\n{short}\n{own[1][2]}",
        f"{own[2][0]}\n{wrapped}\n{own[2][1]}",
        f"{own[3][0]} {own[3][1]}\n{han}{own[3][2]} {inside}",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (8, None), (9, ""), (None, texts[0])], "doc_id bigint, text string")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, str(DATA)).collect()
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == {
        0: texts[0], 1: f"{own[1][0]} {own[1][1]}\n{short}\n{own[1][2]}", 2: f"{own[2][0]}\n{own[2][1]}", 3: f"{own[3][0]} {own[3][1]}\n{own[3][2]} ", 8: None, 9: "",
    }
    assert len(got) == 8 and [r.text for r in got if r.doc_id is None] == [texts[0]]


def test_ids_with_several_texts_and_other_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a, "x", 0), (1, b, "y", 1), (2, f"{a}\n{b}", "z", 2), (3, f"own\n{b}", None, 3)], "doc_id bigint, text string, start string, __n int")
    assert sorted(map(tuple, ld.dedup(docs).collect()), key=lambda r: r[3]) == [(1, a, "x", 0), (1, b, "y", 1), (2, "", "z", 2), (3, "own", None, 3)]
    empty = ld.dedup(docs.where("false"))
    assert empty.count() == 0 and empty.columns == docs.columns


def test_cut():
    assert ld.without("a. b. c.\nd.\ne.", [(3, 2), (9, 2)]) == "a. c.\ne."
    assert ld.without("a.\nb.", [(3, 2)]) == "a." and ld.without("a.\nb.", [(0, 2), (3, 2)]) == ""
    assert ld.without("a.\n\nb.", []) == "a.\n\nb."
