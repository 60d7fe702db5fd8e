"""SKOS inference and merging over whole graphs."""

from graphloom.operators import triples
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_customers_are_members_of_regions(spark):
    got = {tuple(r) for r in catalog.QUERIES["skos_broader"](spark, SF).collect()}
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    region = {r["n_nationkey"]: f"urn:graphloom:/region/{r['n_regionkey']}" for r in read("nation")}
    p = triples.iri("kb:memberOf")
    want = {(f"urn:graphloom:/customer/{r['c_custkey']}", p, region[r["c_nationkey"]]) for r in read("customer")}
    want |= {(f"urn:graphloom:/supplier/{r['s_suppkey']}", p, region[r["s_nationkey"]]) for r in read("supplier")}
    assert got == want


def test_merge_returns_the_triples_of_both(spark):
    got = [tuple(r) for r in catalog.QUERIES["graph_merge"](spark, SF).select("s", "p", "o").collect()]
    want = {(r["s"], r["p"], r["o"]) for g in (triples.star(spark, SF), triples.corpus(spark, SF)) for r in g.collect()}
    assert len(got) == len(want) and set(got) == want
