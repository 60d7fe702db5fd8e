"""Schema search with everything it tells, document-aware search, scopes, answers; and hybrid search among candidates."""

from pyspark.sql import functions as F

from graphloom.bank import KnowledgeBank, KnowledgeGraph, SemanticIndex
from graphloom.operators import search, triples
from graphloom.sources import files

ROWS = [
    ("urn:a", "rdf:type", "schema:Article"), ("urn:a", "schema:name", "Query planning"), ("urn:a", "schema:description", "How query planning works"), ("urn:a", "kb:memberOf", "urn:g"), ("urn:a", "prov:wasDerivedFrom", "urn:doc1"),
    ("urn:b", "rdf:type", "schema:Article"), ("urn:b", "skos:prefLabel", "Joins"), ("urn:b", "kb:memberOf", "urn:g"), ("urn:b", "kb:relatedTo", "urn:a"), ("urn:b", "prov:wasDerivedFrom", "urn:doc2"), ("urn:b", "prov:wasDerivedFrom", "urn:doc3"),
    ("urn:g", "rdf:type", "schema:DefinedTerm"), ("urn:g", "schema:name", "query planning"),
]


def test_matches_tell_label_types_and_evidence(spark):
    g = triples.of_rows(spark, ROWS)
    got = search.schema_matches(g, "query planning").collect()
    by = {r["node_id"]: r for r in got}
    assert [r["node_id"] for r in got] == ["urn:a", "urn:g", "urn:b"]
    a, b = by["urn:a"], by["urn:b"]
    assert a["label"] == "Query planning" and a["description"] == "How query planning works" and a["types"] == [triples.iri("schema:Article")]
    assert [(e["kind"], round(e["score"], 2), e["via"], e["contexts"]) for e in a["evidence"]] == [("direct", 1.0, None, ["urn:doc1"]), ("related", 0.7, "urn:g", ["urn:doc1"]), ("direct", 0.64, None, ["urn:doc1"])]
    assert a["score"] == 2.34 and b["label"] == "Joins" and b["evidence"][0]["contexts"] == ["urn:doc2", "urn:doc3"]
    score = {r["node_id"]: r["score"] for r in search.schema_search(g, "query planning").collect()}
    assert score == {r["node_id"]: r["score"] for r in got}
    nodes, edges = search.schema_subgraph(g, spark.createDataFrame([("urn:a",), ("urn:b",), ("urn:g",)], "node_id string"))
    assert {r["node_id"]: r["label"] for r in nodes.collect()} == {"urn:a": "Query planning", "urn:b": "Joins", "urn:g": "query planning"} and edges.count() == 3


def test_federated_search_says_where_from(spark):
    one, two = KnowledgeGraph(triples.of_rows(spark, ROWS[:5])), KnowledgeGraph(triples.of_rows(spark, [("urn:a", "schema:name", "query planning"), ("urn:z", "schema:name", "other")]))
    rows = one.search_federated("query planning", {"urn:one": one, "urn:two": two}).collect()
    assert [r["node_id"] for r in rows] == ["urn:a"] and {e["endpoint"] for e in rows[0]["evidence"]} == {"urn:one", "urn:two"}
    try:
        one.search_federated("x", {"urn:two": two}, allowed={"urn:one"})
        raise AssertionError
    except PermissionError:
        pass


def test_the_explained_query_finds_the_same_evidence(spark):
    g = KnowledgeGraph(triples.of_rows(spark, ROWS))
    text = search.explain('query planning', search.Profile(excluded_types=()))
    rows = {(r["node"], r["kind"]) for r in g.select(text).collect()}
    assert rows == {(r["node_id"], r["kind"]) for r in search.evidence(g.triples, "query planning").collect()}
    assert search.escaped('a"b\\c\nd') == 'a\\"b\\\\c d'


def test_hybrid_search_keeps_to_the_candidates(spark):
    g = KnowledgeGraph(triples.of_rows(spark, ROWS))
    vectors = spark.createDataFrame([("urn:a", [1.0, 0.0]), ("urn:b", [1.0, 0.1]), ("urn:nowhere", [1.0, 0.0])], "node_id string, embedding array<double>")
    index = SemanticIndex(vectors, lambda q: [1.0, 0.0])
    allowed = spark.createDataFrame([("urn:a",)], "node_id string")
    for fusion in ("canonical", "rrf"):
        assert {r["node_id"] for r in g.search("query", "hybrid", index=index, fusion=fusion, candidates=allowed).collect()} == {"urn:a"}
        assert "urn:nowhere" not in {r["node_id"] for r in g.search("query", "hybrid", index=index, fusion=fusion).collect()}
    assert g["urn:b"]["skos:prefLabel"] == ["Joins"] and {r["node_id"] for r in g.search_focused("query planning", profile=search.Profile())["primary"].collect()} >= {"urn:a"}


def test_answers_from_chunks_within_a_scope(spark):
    sources = files.inline(spark, [("a.md", "# Alpha\n\nThe vacuum cleaner hums.\n\n## More\n\nZebra crossings are striped."), ("b.md", "# Beta\n\nZebra herds wander far."), ("c.md", "# Gamma\n\nNothing here.")])
    made = KnowledgeBank(spark).build(sources)
    asked = []
    out = made.answer("where do they wander?", lambda p: asked.append(p) or "far", rewrite=lambda q: "zebra herds" if "user:" in q else q, history=[("user", "tell me of zebra herds")])
    assert out["answer"] == "far" and [c["document"] for c in out["citations"]] == ["b.md", "a.md"]
    assert "Zebra crossings" in out["citations"][1]["snippet"] and "tell me of zebra herds" in asked[0]
    scope = made.nodes().where("path = 'a.md'").select(F.col("doc_id").alias("node_id"))
    assert [c["document"] for c in made.answer("zebra", lambda p: "x", scope=scope)["citations"]] == ["a.md"]
    one = spark.createDataFrame([("striped zebras cross", "zebras striped herds"), ("zebras", "zebras striped"), (None, "x")], "a string, b string")
    assert [r[0] for r in one.select(search.context_overlap(F.col("a"), F.col("b"))).collect()] == [True, False, False]
