"""Exports of the whole mapped graph."""

import pytest

from graphloom.operators import triples
from graphloom.plans import catalog
from graphloom.sources import rdf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ntriples_lines", "mermaid_edges", "dot_edges", "edge_order"])
def test_exports_hold_every_kind(spark, name):
    g = triples.union(triples.star(spark, SF), triples.corpus(spark, SF))
    df = catalog.QUERIES[name](spark, SF)
    rows = [" ".join(map(str, r)) for r in df.collect()]
    assert len(rows) == (g if name == "ntriples_lines" else g.where("o_kind <> 'literal'")).count()
    for kind in ("region", "nation", "supplier", "customer", "part", "order", "line", "document", "turn", "conversation"):
        assert any(f"urn:graphloom:/{kind}/" in r for r in rows), kind


def test_numbers_go_on_over_partitions(spark):
    rows = [(f"urn:x:{i % 7}", "kb:p", f"urn:y:{i}") for i in range(300)] + [("urn:x:1", "kb:p", "urn:y:1")] * 2
    got = rdf.numbered_edges(triples.of_rows(spark, rows).repartition(3)).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r["s"], r["o"]) for r in got] == sorted((s, o) for s, _, o in rows)
    assert rdf.numbered_edges(triples.empty(spark)).count() == 0
