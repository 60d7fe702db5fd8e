import random

import pytest

from graphloom.operators import index, terms


def corpus(n=120):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("graph", "query", "plan", "naïve", "data", "été", "x") for b in ("", "s", "ed", "ing", "1")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, "...")]


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    return docs, index.build(docs)


@pytest.mark.parametrize("query", ["graph queries", "graphs plan data plan", "nothing here", "", "naïve été", "grap querry plann x"])
def test_rankings_equal_those_by_scan(both, query):
    docs, ix = both
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(ix.bm25(query)) == rows(terms.bm25(docs, query))
    assert rows(ix.bm25(query, fuzzy=1)) == rows(terms.bm25(docs, query, fuzzy=1))
    for k in (3, 200):
        assert rows(ix.token_distance(query, k)) == rows(terms.token_distance(docs, query, k))
    assert sorted(rows(ix.corrections(query, best=2))) == sorted(rows(terms.corrections(docs, query, best=2)))


def test_batches_and_an_empty_table(spark, both):
    docs, ix = both
    queries = spark.createDataFrame([(1, "graph plans"), (2, "zzz"), (3, None)], "item_id int, text string")
    assert sorted(map(tuple, ix.bm25_batch(queries).collect())) == sorted(map(tuple, terms.bm25_batch(docs, queries).collect()))
    none = index.build(docs.limit(0))
    assert none.bm25("graph").count() == none.token_distance("graph").count() == none.bm25("graph", fuzzy=1).count() == 0


def test_a_query_reads_its_buckets_only(both):
    _, ix = both
    plan = ix._of(["graph"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("(bucket#", "(bucket") or "PartitionFilters: [bucket" in plan
