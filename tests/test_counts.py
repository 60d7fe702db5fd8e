"""Terms are counted where documents lie; an index that serves many queries by products."""

import random

import pytest

from graphloom.operators import index, terms
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(40)))) for i in range(300)]
    return spark.createDataFrame([*rows, (900, None), (901, rows[3][1]), (902, rows[3][1])], "doc_id long, text string").repartition(5)


def test_counting_and_own_weights_need_no_shuffle(docs):
    for df in (terms.term_frequency(docs), terms.own_weights(docs), terms.weights(docs, "binary")):
        assert "Exchange hashpartitioning" not in plan(df)
    want = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term")).where("term <> ''").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    assert sorted(terms.term_frequency(docs).collect()) == sorted(want.collect())


def test_rows_that_repeat_an_id_are_one_document(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in terms.term_frequency(df).collect()) == [(1, "a", 1), (1, "b", 2), (1, "c", 1)]


def test_index_has_no_shuffle_by_document(spark, docs, monkeypatch):
    made = index.build(docs)
    monkeypatch.setattr(type(made), "documents", property(lambda self: pytest.fail("norms aren't asked for")))
    assert made.bm25("w1 w2").count() == 10 and made.bm25("w1 w22", fuzzy=1, min_length=2).count() == 10


def test_products_give_what_the_join_gives(spark, docs, monkeypatch):
    queries = docs.where("doc_id % 30 = 0 OR doc_id > 900").select(F.col("doc_id").alias("item_id"), "text")
    made = index.build(docs)
    fast = made.bm25_batch(queries, 3)
    assert "MapInArrow" in plan(fast)
    monkeypatch.setattr(index, "_MATRIX", 0)
    slow = made.bm25_batch(queries, 3)
    assert "MapInArrow" not in plan(slow)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) == sorted(map(tuple, terms.bm25_batch(docs, queries, 3).collect()))
