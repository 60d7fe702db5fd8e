"""Rows as objects a few at a time, and notes' graphs that are made once."""

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import rows
from graphloom.operators import build, documents
from graphloom.plans import notes


def test_slices_hold_few_bytes_and_all_rows():
    batch = pa.record_batch({"i": list(range(1000)), "t": ["x" * 20_000] * 1000})
    parts = list(rows.slices(batch))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) <= 2 * rows.CHUNK_BYTES // 20_000
    assert not list(rows.slices(batch.slice(0, 0)))


def test_rows_of_a_text_leave_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "# a\n" * 30_000), (2, None), (3, "one\n# b\ntwo")], "doc_id long, text string")
    found = documents.sections(docs)
    assert found.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 30_000), (3, 2)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= rows.BATCH_BYTES
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()  # which gives back as many rows as it gets


def test_a_notes_graph_is_parsed_once(spark, monkeypatch):
    made = []
    whole = build.authored
    monkeypatch.setattr(build, "authored", lambda *a, **k: made.append(1) or whole(*a, **k))
    plan = notes.note_concepts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert made == [1] and "MapInArrow" not in plan and "MapInPandas" not in plan
    sources = spark.createDataFrame([("a.md", "---\ntitle: A\n---\nx")], "path string, content string")
    assert "MapInArrow" not in build.graph(sources)._jdf.queryExecution().toString()


def test_words_of_notes(spark):
    df = spark.createDataFrame([("-ab.c\n",), ("",), (None,), ("é\U0001f600 x--",)], "text string")
    split, replaced = F.array_join(F.split("text", "[^A-Za-z ]", -1), " "), F.regexp_replace("text", "[^A-Za-z ]", " ")
    assert df.where(~split.eqNullSafe(replaced)).count() == 0
