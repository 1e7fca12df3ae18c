"""The prefix trie, winnowing and spelling variants against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from quireworks.llm import prefix_trie, spelling_variants, winnowing

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, id int, key string"

# 11


def rebuilt_by_loop(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(x)] for c, x in by.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = said.get(c - c % 20, [])[:h] + own[h:]
    return out


def trie_by_loop(said):
    """Nodes of {conv_id: turns} as sorted tuples."""
    members = {}
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = sum((len(members[p]) - 1) * len(SPACED.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(said[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children(path)), sum(not children(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_conversations(rng, n):
    out = []
    for c in range(n):
        kind = rng.random()
        turns = [("system", "be kind")] if kind < 0.6 else []
        if kind < 0.3:
            turns += [("user", "hello there"), ("assistant", "good day to you")]
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b b", "c c c", "", None, "é è"])) for _ in range(rng.randint(0, 4))]
        out += [(c, k, r, t, "x", 1, "y") for k, (r, t) in enumerate(turns)]
    return out


@pytest.mark.parametrize("n", [1, 12, 90])
def test_trie_equals_loop(spark, n):
    table = made_conversations(random.Random(n), n)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(table, TURNS))))
    assert rows(found) == trie_by_loop(rebuilt_by_loop(table))


def test_trie_of_odd_rows(spark):
    table = [(None, 1, "user", "no conversation", "x", 1, "y"), (3, None, None, None, "x", 1, "y"), (3, None, "b", "tie", "x", 1, "y"), (3, None, "a", "tie", "x", 1, "y"), (3, 5, "user", "same", "x", 1, "y"), (3, 5, "user", "same", "x", 1, "y"), (7, 1, "user", "w " * 50_000, "x", 1, "y"), (20, 0, "user", "", "x", 1, "y"), (-5, 2, "a", "b", "x", 1, "y")]
    table += [(c, k, "user", str(k), "x", 1, "y") for c in (40, 41) for k in range(300)]
    said = rebuilt_by_loop([r for r in table if r[0] is None or r[0] >= 0])
    made = spark.createDataFrame(table, TURNS)
    assert rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(made.where("conv_id >= 0 OR conv_id IS NULL"))))) == trie_by_loop(said)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(made))).count() > 0
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(made.where("false")))).count() == 0


def test_one_conversation_many_times(spark):
    """A group of copies is dealt over shards, and its ends are one digest."""
    table = [(c, k, "user", f"t{k}", "x", 1, "y") for c in range(0, 4000, 20) for k in range(3)]
    said = {c: [("user", "t0"), ("user", "t1"), ("user", "t2")] for c in range(0, 4000, 20)}
    assert rows(prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame(table, TURNS)))) == trie_by_loop(said)


@pytest.mark.parametrize("seed", range(6))
def test_shards_add_up(seed):
    """Nodes of shards cut anywhere sum up to those of a single one."""
    rng = random.Random(seed)
    seqs = sorted(([rng.randint(0, 2) for _ in range(rng.randint(0, 5))], c) for c in range(40))
    part = [(s, c, [x + 1 for x in s]) for s, c in seqs]
    cuts = sorted(rng.sample(range(1, 40), 6))
    shards = [part[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]

    def common(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    whole = prefix_trie.shard_nodes(part, -1, -1)
    summed, ids = {}, {}
    for i, shard in enumerate(shards):
        before = common(shard[0][0], shards[i - 1][-1][0]) if i else -1
        after = common(shard[-1][0], shards[i + 1][0][0]) if i + 1 < len(shards) else -1
        out = prefix_trie.shard_nodes(shard, before, after)
        for k, key in enumerate(out["key"]):
            if key is not None:
                n = summed.setdefault(key, [out["depth"][k], [], Counter()])
                n[1].append(out["conv_id"][k])
                n[2].update({c: out[c][k] for c in prefix_trie._SUMS})
                if out["end_ids"][k]:
                    ids.setdefault(key, []).append(out["end_ids"][k])
            else:
                ids.setdefault((i, k), None)
                summed[i, k] = [out["depth"][k], [out["conv_id"][k]], Counter({c: out[c][k] for c in prefix_trie._SUMS})]
    got = sorted((d, min(c), *(s[x] for x in prefix_trie._SUMS)) for d, c, s in summed.values())
    assert got == sorted(zip(whole["depth"], whole["conv_id"], *(whole[x] for x in prefix_trie._SUMS), strict=True))
    ends = {hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids.values() if x}
    assert ends <= set(whole["ends_sha256"])


def test_medians_balance_the_tree():
    assert sorted(prefix_trie.medians(100)) == list(range(100))
    tree = prefix_trie.Tree()
    for m in prefix_trie.medians(1000):
        tree.insert([m], [1], [m])

    def height(t):
        todo, most = [(t, 1)], 0
        while todo:
            t, h = todo.pop()
            if t >= 0:
                most = max(most, h)
                todo += [(tree.low[t], h + 1), (tree.high[t], h + 1)]
        return most

    assert height(tree.below[0]) <= 11


# 12

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_by_loop(docs, items):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    asked = {}
    for i, text in items:
        w = ITEM.findall(lower(text))
        if i is not None and w:
            s = min(10, len(w))
            for k in range(len(w) - s + 1):
                asked.setdefault(tuple(w[k : k + s]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, found = ITEM.findall(lower(text)), set(), set()
        for s in {len(x) for x in asked}:
            for k in range(len(w) - s + 1):
                if (x := tuple(w[k : k + s])) in asked:
                    hit |= set(range(k, k + s))
                    found |= asked[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


DOCS, ITEMS = "doc_id bigint, text string, item_id string, key string, span int", "item_id bigint, text string, key string, window string"


def test_leaks_equal_loop(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["Éa", "b"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, said(rng.choice([1, 2, 4, 9, 10, 11, 30]))) for i in range(30)] + [(30, None), (31, " ,.; "), (None, said(12)), (5, said(10)), (32, "one two three")]
    docs = [(d, said(rng.randint(0, 60)) + (" " + rng.choice(items[:30])[1].upper() + "! " if d % 2 else "") + said(rng.randint(0, 60))) for d in range(60)]
    docs += [(70, None), (71, ""), (72, "One, TWO\nthree"), (72, "One, TWO\nthree"), (None, "one two three"), (73, said(20_000)), (74, "é " * 12)]
    a = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y", "z") for i, t in items], ITEMS)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(winnowing.contamination(a, b), *columns) == leaks_by_loop(docs, items)
    assert rows(winnowing.contamination(a, b.where("false")), *columns) == leaks_by_loop(docs, [])
    assert winnowing.contamination(a.where("false"), b).count() == 0


def test_large_benchmarks_shuffle(spark, monkeypatch):
    docs = [(1, "a b c d e f g h i j k l"), (2, "nothing of it"), (3, "x a b c d e f g h i j")]
    items = [(1, "a b c d e f g h i j"), (2, "nothing of")]
    made = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(winnowing, "BROADCAST_PRINTS", 0)
    assert rows(winnowing.contamination(*made), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == leaks_by_loop(docs, items)


@pytest.mark.parametrize("k", [3, 5, 8, 10])
def test_shared_spans_share_a_fingerprint(spark, k):
    """A fingerprint for each span, set by its words alone."""
    rng = random.Random(k)
    texts = [(i, [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 40))]) for i in range(40)]
    from pyspark.sql import functions as F

    found = {r.i: r.p for r in spark.createDataFrame(texts, "i int, w array<string>").select("i", winnowing.fingerprints(F.col("w"), 10, k).alias("p")).collect()}
    by = {}
    for i, w in texts:
        assert len(found[i]) == max(0, len(w) - 9)
        for at, p in enumerate(found[i]):
            assert by.setdefault(tuple(w[at : at + 10]), p) == p
    assert len(set(by.values())) > 20


# 13


def words_by_loop(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a))))


def variants_by_loop(n):
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def made_words(rng, n):
    out = {}
    while len(out) < n:
        w = "".join(rng.choice("abeéñz") for _ in range(rng.randint(5, 8)))
        for _ in range(rng.randint(1, 4)):
            k = rng.randint(0, len(w) - 1)
            out[w] = rng.choice([3, 4, 6, 8, 20, 50])
            w = rng.choice([w[:k] + w[k + 1 :] + "q", w[:k] + rng.choice("abexé") + w[k + 1 :], w[:k] + rng.choice("abß") + w[k:], w[:k] + w[k + 1 :]])
            if len(w) < 5:
                break
    return out


@pytest.mark.parametrize("levels", [3, 5])
def test_variants_equal_loop(spark, monkeypatch, levels):
    n = made_words(random.Random(levels), 700)
    n |= {"a" * 60: 3, "a" * 59 + "b": 9, "a" * 61: 30, "ab" * 100: 3, "ab" * 100 + "a": 7}
    if levels > 3:
        monkeypatch.setattr(spelling_variants, "WORDS_OF_THREE", len(n) // 16)
    table = spark.createDataFrame([(w, c) for w, c in n.items()], "word string, n bigint")
    assert rows(spelling_variants.spelling_variants(table), *COLUMNS) == variants_by_loop(n)


def test_crowded_leaves(spark, monkeypatch):
    """Words with equal letter counts are too many to compare one by one; masks find the same."""
    monkeypatch.setattr(spelling_variants, "MANY_PAIRS", 4)
    monkeypatch.setattr(spelling_variants, "FEW_PAIRS", 0)
    rng = random.Random(4)
    n = {"".join(rng.choice("éàüß") for _ in range(6)): rng.randint(3, 60) for _ in range(300)} | {"".join(rng.sample("stones", 6)): rng.randint(3, 60) for _ in range(100)}
    n |= {"".join(rng.choice("éàüß") for _ in range(7)): rng.randint(3, 60) for _ in range(100)}
    table = np.array(sorted(n), dtype=object)
    words = np.concatenate([table, table, table])
    kinds = np.repeat([spelling_variants.STORED, spelling_variants.SAME, spelling_variants.LONGER], len(table))
    a, b = spelling_variants.near_words(words, np.zeros(len(words), dtype=np.int64), kinds)
    got = sorted(tuple(sorted(p)) for p in zip(a, b, strict=True))
    assert got == sorted((x, y) for x in n for y in n if x < y and near(x, y)) and len(got) > 100


def test_runs_and_odd_rows(spark):
    rng = random.Random(9)
    docs = [(d, " ".join(rng.choice(["Spelling", "colour", "color", "ÉTUDES", "naïve×", "a", "bridge's", "x1y"]) for _ in range(60))) for d in range(40)]
    docs += [(90, None), (91, ""), (None, "Spelling " * 5), (92, "y" * 30_000 + " " + "longer words " * 9), (92, "colour colour")]
    made = spark.createDataFrame([(d, t, "w", 3) for d, t in docs], "doc_id bigint, text string, word string, n int")
    found = spelling_variants.runs(made)
    assert dict(rows(found)) == words_by_loop(docs)
    assert rows(spelling_variants.spelling_variants(found), *COLUMNS) == variants_by_loop(words_by_loop(docs))
    assert spelling_variants.spelling_variants(spelling_variants.runs(made.where("false"))).count() == 0


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(70)], "word string, form string")
    assert set(rows(spelling_variants.roots(forms), "root")) == {("w070",)}
