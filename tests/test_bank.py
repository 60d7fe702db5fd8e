import pytest

from graphloom.bank import KnowledgeBank, KnowledgeGraph
from graphloom.functions.text import slug_of
from graphloom.operators import build, documents, shapes, triples
from graphloom.sources import files, rdf, yamlish

NOTE = """---
title: Query Planning
tags: [spark, Graphs, spark]
about:
  - label: Optimizer
    sameAs: [https://example.org/optimizer]
author: Ada Li
date_published: 2024-03-02
graph_groups: [Runbooks]
graph_next_steps: ["Deploy Guide"]
graph_edges:
  - {subject: Optimizer, predicate: relatedTo, object: Cost Model}
  - {subject: Optimizer, predicate: "", object: x}
rdf_properties:
  kb:level: 3
---
intro text

# Scan
Reads [the guide](../guide/deploy.md#top "T") and [[Cost Model|costs]].

## Filter
```
# not a fence heading
```
Pushes filters down.
"""
OTHER = "---\ntitle: Deploy Guide\nsummary: How to deploy\ngraph_groups: [Runbooks]\n---\n# Steps\nFirst deploy the engine, then watch it.\n"


@pytest.fixture(scope="module")
def bank(spark):
    sources = files.inline(spark, [("content/notes/query-planning.md", NOTE), ("guide/deploy.md", OTHER), ("empty.md", "")])
    return KnowledgeBank(spark).build(sources)


def facts(g):
    return {(r["s"], r["p"], r["o"]) for r in g.collect()}


def test_triples_of_front_matter(bank):
    got = facts(bank.graph.triples)
    doc, i = triples.BASE + "notes/query-planning/", triples.iri
    idn = lambda x: triples.BASE + "id/" + slug_of(x)
    for want in [
        (doc, triples.TYPE, i("schema:Article")), (doc, i("schema:name"), "Query Planning"), (doc, i("prov:wasDerivedFrom"), doc), (doc, i("schema:keywords"), "spark"), (doc, i("schema:keywords"), "Graphs"),
        (doc, i("schema:about"), idn("Optimizer")), (idn("Optimizer"), i("schema:sameAs"), "https://example.org/optimizer"), (doc, i("schema:author"), idn("Ada Li")), (doc, i("schema:datePublished"), "2024-03-02"),
        (doc, i("kb:memberOf"), idn("Runbooks")), (doc, i("kb:nextStep"), idn("Deploy Guide")), (idn("Optimizer"), i("kb:relatedTo"), idn("Cost Model")), (doc, i("kb:level"), "3"),
        (idn("Runbooks"), triples.TYPE, i("skos:Concept")), (idn("Optimizer"), i("skos:exactMatch"), "https://example.org/optimizer"), (doc, triples.TYPE, i("kb:MarkdownDocument")),
    ]:
        assert want in got, want
    assert sum(p == i("schema:keywords") for _, p, _ in got) == 2
    assert not any(s.endswith("empty/") for s, _, _ in got)
    assert [r["path"] for r in bank.problems.collect()] == ["content/notes/query-planning.md"]


def test_search_and_answers(bank):
    g = bank.graph
    assert g.search("query planning").first()["score"] == 1.0
    assert g.search("deploy", "bm25").first()["node_id"].endswith("guide/deploy/") or g.search("deploy", "bm25").count()
    focused = g.search_focused("Query Planning")
    assert [r["node_id"] for r in focused["next_steps"].collect()] == [triples.BASE + "id/deploy-guide"]
    assert triples.BASE + "guide/deploy/" in {r["node_id"] for r in focused["related"].collect()}
    assert focused["graph"].count() > 3
    assert g.search_by_schema("optimizer")["primary"].first()["node_id"] == triples.BASE + "id/optimizer"
    with pytest.raises(ValueError):
        g.search("x", "semantic")
    with pytest.raises(ValueError):
        g.search("x", k=0)
    index = g.semantic_index(lambda df: df.selectExpr("node_id", "array(cast(contains(lower(text), 'deploy') as double), 1.0) AS embedding"), lambda q: [1.0, 1.0])
    assert g.search("deploy", "hybrid", index=index, fusion="rrf").count() > 0
    out = bank.answer("watch the engine", lambda prompt: prompt.split("\n")[-1])
    assert out["citations"][0]["document"] == "guide/deploy.md" and out["answer"] == "Question: watch the engine"
    assert g.validate().count() == 0
    assert g.validate([shapes.Shape("d", "schema:description", "schema:Article", min_count=1)]).count() == 1


def test_sections_chunks_links(bank):
    rows = documents.outline(documents.front_matter(NOTE)[1])
    assert [(s["level"], s["heading"], s["path"]) for s in rows] == [(0, None, []), (1, "Scan", ["Scan"]), (2, "Filter", ["Scan", "Filter"]), (1, "not a fence heading", ["not a fence heading"])]
    links = documents.links_of(NOTE, "notes/query.md")
    assert [(x["kind"], x["resolved"], x["external"]) for x in links] == [("link", "guide/deploy/#top", False), ("wiki", "cost-model/", False)]
    assert documents.pack([400, 402, 3000, 10, 20], 200) == [0, 1, 2, 3, 3] and documents.pack([10, 10, 10], 100) == [0, 0, 0]
    text = "\n\n".join("word " * 30 for _ in range(10))
    for overlap in (0, 60):
        parts = documents.chunks_of(text, 100, overlap)
        assert all(c["tokens"] <= 100 for c in parts) and len(parts) > 2
    assert bank.chunks().count() >= 4 and documents.links(bank.sources, "path", "content", "path").count() == 2
    with pytest.raises(ValueError):
        documents.front_matter("---\ntitle: x\n")


@pytest.mark.parametrize("kind", ["ntriples", "turtle", "jsonld", "xml"])
def test_saved_graphs_load_again(spark, bank, tmp_path, kind):
    odd = triples.of_rows(spark, [("kb:x", "schema:name", 'say "hi"\n\\ there'), ("kb:x", "kb:size", 4), ("kb:x", "kb:ok", True)])
    g = bank.graph.merge(KnowledgeGraph(odd))
    g.save(f"{tmp_path}/{kind}", kind)
    assert facts(KnowledgeGraph.load(spark, f"{tmp_path}/{kind}", kind).triples) == facts(g.triples)


def test_graph_files_of_all_formats_are_one_graph(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<urn:a> <urn:p> "1" <urn:g> .\n# note\n<urn:a> <urn:p> <urn:b> .\n')
    (tmp_path / "b.trig").write_text('@prefix e: <urn:> .\nGRAPH e:g { e:a e:q "x"@en . }\ne:h { e:a e:p e:b }\n')
    (tmp_path / "c.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:"><e:T rdf:about="urn:c"><e:p><rdf:Description><e:q>y</e:q></rdf:Description></e:p></e:T></rdf:RDF>')
    (tmp_path / "d.md").write_text("no graph")
    g = KnowledgeGraph.load_directory(spark, str(tmp_path))
    assert {("urn:a", "urn:p", "1"), ("urn:a", "urn:p", "urn:b"), ("urn:a", "urn:q", "x"), ("urn:c", triples.TYPE, "urn:T")} <= facts(g.triples)
    assert g.triples.count() == 6
    nodes, edges = g.snapshot()
    assert edges.count() == 6 and nodes.where("id = 'urn:c'").first()["kind"] == "iri"
    with pytest.raises(ValueError):
        rdf.kind_of("x.md")


def test_turtle_syntax():
    got = rdf.parse_turtle('@prefix e: <urn:e:> .\ne:a a e:T ; e:p "x"@en, 4 ; e:q [ e:r true ] .\n<urn:e:b> e:p e:a .')
    assert ("urn:e:a", "iri", "urn:e:p", "x", "literal", None, "en") in got and ("urn:e:b", "iri", "urn:e:p", "urn:e:a", "iri", None, None) in got and len(got) == 6


def test_incremental_and_diff(spark, bank):
    later = files.inline(spark, [("content/notes/query-planning.md", NOTE.replace("Query Planning", "Plans")), ("new.md", "# New\nfresh")])
    new, plan, diff = KnowledgeBank(spark).build_incremental(bank, later)
    assert {(r["path"], r["change"]) for r in plan.collect()} == {("content/notes/query-planning.md", "changed"), ("new.md", "changed"), ("guide/deploy.md", "removed"), ("empty.md", "removed")}
    assert ("Query Planning", "Plans") in {(r["old"], r["new"]) for r in diff["literals"].collect()}
    assert new.graph.diff(new.graph)["edges"].count() == 0


def test_inference(spark):
    g = KnowledgeGraph(triples.of_rows(spark, [("kb:A", "rdfs:subClassOf", "kb:B"), ("kb:B", "rdfs:subClassOf", "kb:A"), ("kb:x", "rdf:type", "kb:A"), ("kb:p", "rdfs:domain", "kb:D"), ("kb:p", "rdfs:subPropertyOf", "kb:q"), ("kb:x", "kb:p", "kb:y"), ("kb:c", "skos:broader", "kb:d"), ("kb:doc", "schema:about", "kb:c")]))
    got = facts(g.infer().triples)
    i = triples.iri
    assert {(i("kb:x"), triples.TYPE, i("kb:B")), (i("kb:x"), triples.TYPE, i("kb:D")), (i("kb:x"), i("kb:q"), i("kb:y")), (i("kb:doc"), i("schema:about"), i("kb:d"))} <= got


def test_token_facts(spark):
    sources = files.inline(spark, [("a.md", "# One\nspark plans queries well\nspark joins tables"), ("b.md", "spark plans queries")])
    got = facts(build.token_facts(sources))
    assert any(p == triples.iri("kb:relatedTo") for _, p, _ in got) and any("token-topic/" in o for _, p, o in got)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿é one".encode())
    (tmp_path / "sub/b.txt").write_bytes("two".encode("utf-16"))
    (tmp_path / "c.bin").write_bytes(b"\x00\x01\xff")
    rows = {r["path"]: (r["content"], r["media_type"]) for r in files.read(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": ("é one", "text/markdown"), "sub/b.txt": ("two", "text/plain")}
    assert files.read(spark, str(tmp_path), "*.md").count() == 1


def test_yaml_without_the_library():
    text = "title: A b\nn: 3\nlist:\n  - x\n  - label: y\n    type: z\nflat: [a, b]\nmap:\n  k: true\n"
    assert yamlish._load(text) == {"title": "A b", "n": 3, "list": ["x", {"label": "y", "type": "z"}], "flat": ["a", "b"], "map": {"k": True}}
    assert yamlish.load_yaml(text) == yamlish._load(text)


@pytest.mark.parametrize("label,slug", [("Über Café_x/y.z", "uber-cafexyz"), ("  a -- b ", "a-b"), ("", "item"), (None, "item"), ("日本", "")])
def test_slugs(label, slug):
    assert slug_of(label) == slug
