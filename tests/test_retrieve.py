from __future__ import annotations

import re

from conftest import DATA

from quireworks.queries import QUERIES


def test_whole_texts_are_scored(spark):
    """Each item's best score among the texts that stay as they are is that of a loop over whole texts, wherever in them its terms stand."""
    terms = lambda t: {x for x in re.split(r"[\W_]+", t.lower()) if len(x) > 2}
    docs = [terms(f"{r.text or ''} {r.source} {r.lang}") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.doc_id % 4]
    asked = {str(r.item_id): terms(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    best = {r.query_id: r.score for r in QUERIES["i11_retrieve_whole"](spark, str(DATA)).where("rank = 1").collect()}
    assert {i: best[i] for i in asked} == {i: max(len(t & d) for d in docs) for i, t in asked.items()}


def test_scores_are_added_up_where_postings_are(spark):
    """Postings are dealt out by document once: neither they nor the pairs that are left move for common terms."""
    plan = QUERIES["i11_retrieve"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert "Bucketed: true" in QUERIES["i11_retrieve_whole"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
