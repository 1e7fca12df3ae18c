from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from conftest import DATA, rows
from test_near_copies import kept_by_loop
from test_passages import repeats_by_loop

import corpus_pipeline
from quireworks.llm import bpe_stream, line_dedup, quality_gam, queries, simhash, source_mix


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA)).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
        if name == "drop_near_copies":
            found = simhash.simhash_components(docs)
            assert Counter(r.component_id for r in found.collect()).most_common(1)[0][1] == 1
    assert kept[0] > kept[1] > kept[2] == kept[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    codec = bpe_stream.codec(queries.tokenizer_path("word_bpe_49k.json"))
    assert Counter((r.doc_id, r.n_tokens) for r in last.collect()) == Counter((r.doc_id, len(codec.encode(r.text)) // 4) for r in docs.collect())
    assert rows(corpus_pipeline.run(spark, str(DATA))) == rows(last)


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def mixed_by_loop(spark, docs):
    """Rows (doc_id, text, source) as the mix takes them: by source, in the seeded order, whole rounds and the part of one that comes nearest."""
    from pyspark.sql import functions as F

    turn = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in {d for d, *_ in docs}], "d bigint").select("d", source_mix.turn_of(F.col("d"))).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    quota, out = source_mix.targets(dict(sizes)), []
    for source, n in sizes.items():
        own = sorted((turn[d], d, t) for d, t, s in docs if s == source)
        taken = min(round(quota[source]), 2 * n)
        full, rest = (taken // n, taken % n) if n else (0, 0)
        upto, best = 0, (rest, -1)
        for k, group in itertools.groupby(own, key=lambda x: x[0]):
            upto += sum(size(t) for _, _, t in group)
            best = min(best, (abs(upto - rest), k), key=lambda x: x[0])
        cut = best[1] if rest else -1
        out += [(d, t) for k, d, t in own for _ in range(full + (k <= cut))]
    return out


def test_run_equals_loops(spark, tmp_path):
    """The whole run on a table with nulls, repeated rows, a very long text, near copies, shared passages and columns that clash with the stages' own."""
    rng = random.Random(31)
    real = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text][:110]
    word = lambda: rng.choice(real[rng.randrange(110)].text.split())
    texts = {r.doc_id: r.text for r in real}
    for k in range(12):
        edited = real[k].text.split()
        edited[rng.randrange(len(edited))] = "edited"
        texts[5000 + k] = " ".join(edited)
    passage = " ".join(word() for _ in range(70))
    for k in range(5):
        texts[6000 + k] = f"{' '.join(word() for _ in range(90))}. {passage}. {' '.join(word() for _ in range(90))}."
    texts |= {7000: None, 7001: "", 7002: " ".join(word() for _ in range(40_000))}
    given = [(d, t, "en", ["a", "b", None][d % 3], len(t or ""), "x", 1, "y") for d, t in texts.items()]
    given += [given[3], given[3], (None, "no id " * 30, "en", "a", 1, "x", 1, "y")]
    spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint, pattern string, turn int, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = quality_gam.keep(docs, model).collect()
    assert 20 < len(good) < len(given)
    held = {r.doc_id: r.text for r in good if r.doc_id is not None}
    stay = kept_by_loop(held)
    left = {d: held[d] for d in sorted(stay)}
    gone = {}
    for row in repeats_by_loop(left):
        gone.setdefault(row[0], []).append((row[1], row[2]))
    assert any(6000 <= d < 6005 for d in gone)
    cut = {d: line_dedup.without(t, gone[d]) if d in gone else t for d, t in left.items()}
    last = [(r.doc_id, cut[r.doc_id] if r.doc_id is not None else r.text, r.source) for r in good if r.doc_id is None or r.doc_id in stay]
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in mixed_by_loop(spark, last))
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
