from __future__ import annotations

import itertools
import random
import re

from conftest import DATA

import corpus_pipeline
from quireworks.llm import near_copies, simhash


def shingles_by_loop(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept_by_loop(texts):
    """Ids that stay: the smallest of each component over 5-word similarity of 0.8 and fingerprints within 2 bits."""
    sets, fps = {i: shingles_by_loop(t) for i, t in texts.items()}, {i: simhash.fingerprint(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if (x and y and len(x & y) >= 0.8 * len(x | y) or (fps[a] ^ fps[b]).bit_count() <= 2) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return {i for i, v in label.items() if i == v}


def test_planted_near_copies(spark):
    """Copies with a few words replaced, in a chain (each an edit of the one before) and in a star, beside unlike texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    texts: list = [None, "", "one two", "One  two", "one two three"]
    for _ in range(25):
        text = [word() for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(text))
        chained = text
        for _ in range(rng.randint(0, 5)):
            edited = list(text if rng.random() < 0.5 else chained)
            for _ in range(rng.randint(1, max(1, len(edited) // 45))):
                edited[rng.randrange(len(edited))] = word()
            chained = edited
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    held = dict(enumerate(texts))
    docs = spark.createDataFrame([*held.items(), (None, "no id"), (3, held[3])], "doc_id bigint, text string")
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(DATA)).collect()]
    want = kept_by_loop(held)
    assert {i for i in left if i is not None} == want and None in left
    by_simhash = {r.doc_id for r in simhash.dedup(docs).collect()} - {None}
    assert len(by_simhash) > len(want) + 10  # radius 2 alone keeps near copies


def test_near_copies_of_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(DATA)).collect()}
    assert left == kept_by_loop({r.doc_id: r.text for r in docs.collect()})
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), str(DATA)).count() == 0


def test_parities_bound():
    """Parities never differ in more bits than the sets do in hashes, so no pair is ruled out wrongly."""
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 40, 700, 9000):
        for share in (0.0, 0.05, 0.3, 1.0):
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) >= share], rng.integers(0, 1 << 64, int(share * n), dtype=np.uint64)]))
            bits = sum(int(v).bit_count() for v in (near_copies.parities(x) ^ near_copies.parities(y)).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y))


def test_settled_deletes(spark):
    """What is saved on the way goes; the result stays readable."""
    import os

    from quireworks.llm.common import save, settled, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = settled(spark, lambda: save(save(spark.range(5)).where("id > 1")).where("id < 4"))
    assert sorted(r.id for r in got.collect()) == [2, 3]
    assert len(set(os.listdir(folder)) - before) == 1
