"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import tempfile

import pytest
from conftest import DATA, same_rows

from quireworks.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, str(DATA)), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def _with_table(duck, name, df):
    """A folder with one table, which DuckDB sees too."""
    folder = tempfile.mkdtemp(prefix="spark-")
    df.write.parquet(f"{folder}/{name}.parquet")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, own


def test_content_pages_with_own_words(spark, duck):
    bodies = [
        "<body><article>All rights reserved.</article></body>", "<body><p>Copyright ISBN All rights reserved</p></body>", "<body><ARTICLE>Copy<b>right</b> 出版社 字数</ARTICLE></body>", "<p>no body</p>", "<body><img></body>",
        '<body><p class="toc-title">x</p></body>', "<body>" + '<div class="toc">x</div>' * 5 + "</body>", None,
    ]
    pages = spark.createDataFrame([(k, b) for k, b in enumerate(b for b in bodies for _ in range(24))], "page_id bigint, html string")
    folder, own = _with_table(duck, "pages", pages)
    same_rows(QUERIES["e9_content_pages"](spark, folder), own, ORACLES["e9_content_pages"])


def test_references_without_title(spark, duck):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(t for t in ("831610743456 then", "", "A title") for _ in range(6))], "doc_id bigint, text string")
    folder, own = _with_table(duck, "documents", docs)
    same_rows(QUERIES["v10_reference_format"](spark, folder), own, ORACLES["v10_reference_format"])
