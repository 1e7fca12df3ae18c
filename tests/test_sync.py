"""A chunk table that follows an inbox: revised and vanished files, small batches, a crash before the commit."""

from __future__ import annotations

import os
import tempfile

import pytest
from conftest import rows

from quireworks.sources.documents import to_lines
from quireworks.streaming.sync import ChunkTable


def put(folder, name, *docs):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}), f"{folder}/{name}")


@pytest.fixture
def place():
    folder = tempfile.mkdtemp(prefix="spark-")
    os.mkdir(f"{folder}/in")
    return folder


def lines(table):
    found = table.rows()
    return [] if found is None else rows(found, "doc_id", "line_no", "line")


def test_changes_are_followed(spark, place):
    table, inbox = ChunkTable(spark, f"{place}/out"), f"{place}/in"
    sync = lambda **k: table.sync(inbox, make=to_lines, **k)
    assert sync() == 0 and lines(table) == []
    put(inbox, "a.parquet", (1, "one\ntwo"), (2, ""))
    put(inbox, "b and ü.parquet", (3, "three"))
    assert sync(most=1) == 2 and sync() == 0
    assert lines(table) == [(1, 1, "one"), (1, 2, "two"), (3, 1, "three")]
    put(inbox, "a.parquet", (1, "uno"), (4, "four, which is new"))
    assert sync() == 1
    assert lines(table) == [(1, 1, "uno"), (3, 1, "three"), (4, 1, "four, which is new")]
    os.remove(f"{inbox}/b and ü.parquet")
    put(inbox, "c.parquet", (5, "five"))
    assert sync() == 1 and lines(table) == [(1, 1, "uno"), (4, 1, "four, which is new"), (5, 1, "five")]
    put(inbox, "b and ü.parquet", (3, "three again"))
    assert sync() == 1 and (3, 1, "three again") in lines(table)
    assert table.log().count() == 6


def test_a_crash_before_the_commit(spark, place):
    table, inbox = ChunkTable(spark, f"{place}/out"), f"{place}/in"
    put(inbox, "a.parquet", (1, "one"))
    table.sync(inbox, make=to_lines)
    put(inbox, "a.parquet", (1, "changed to more"))

    def crash(batch):
        assert os.path.isdir(f"{place}/out/rows/batch={batch}")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.sync(inbox, make=to_lines, before_commit=crash)
    assert lines(ChunkTable(spark, f"{place}/out")) == [(1, 1, "one")]
    assert ChunkTable(spark, f"{place}/out").sync(inbox, make=to_lines) == 1
    assert lines(table) == [(1, 1, "changed to more")]


def test_two_runs_at_once(spark, place):
    table, inbox = ChunkTable(spark, f"{place}/out"), f"{place}/in"
    put(inbox, "a.parquet", (1, "one"))
    with pytest.raises(RuntimeError):
        table.sync(inbox, make=to_lines, before_commit=lambda batch: ChunkTable(spark, f"{place}/out").sync(inbox, make=to_lines))
    assert lines(table) == [(1, 1, "one")] and table.log().count() == 1
