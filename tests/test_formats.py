import json
import time

import pytest

from graphloom import bank
from graphloom.operators import build, documents, shapes, terms, triples
from graphloom.operators.search import Profile
from graphloom.sources import fragments, rdf, stores
from graphloom.streaming import ingest

LD = {
    "@context": {"@vocab": "https://schema.org/", "ex": "urn:ex:", "knows": {"@type": "@id"}, "steps": {"@id": "ex:steps", "@container": "@list"}, "title": {"@id": "name", "@language": "en"}, "inside": {"@reverse": "ex:holds"}, "nothing": None},
    "@graph": [
        {"@id": "ex:a", "@type": ["Article", "ex:Note"], "title": "A", "knows": "ex:b", "author": {"name": "Ann", "age": 30}, "steps": ["x", "y"], "nothing": "gone", "inside": {"@id": "ex:box"}},
        {"@id": "ex:b", "score": 1.5, "ok": True, "made": {"@value": "2024-01-02", "@type": "ex:date"}},
    ],
}


def test_jsonld_as_others_write_it(spark, tmp_path):
    rows = {(s, p, o, k, d, lang) for s, _, p, o, k, d, lang in rdf.expanded(LD)}
    s, x = "https://schema.org/", triples.XSD
    assert {("urn:ex:a", triples.TYPE, s + "Article", "iri", None, None), ("urn:ex:a", triples.TYPE, "urn:ex:Note", "iri", None, None), ("urn:ex:a", s + "name", "A", "literal", None, "en"), ("urn:ex:a", s + "knows", "urn:ex:b", "iri", None, None), ("urn:ex:box", "urn:ex:holds", "urn:ex:a", "iri", None, None), ("urn:ex:b", s + "score", "1.5", "literal", x + "double", None), ("urn:ex:b", s + "ok", "true", "literal", x + "boolean", None), ("urn:ex:b", s + "made", "2024-01-02", "literal", "urn:ex:date", None)} <= rows
    author = next(o for a, p, o, *_ in rows if a == "urn:ex:a" and p == s + "author")
    assert author.startswith("_:") and (author, s + "age", "30", "literal", x + "integer", None) in rows and not any("gone" in r for r in rows)
    cell = next(o for a, p, o, *_ in rows if p == "urn:ex:steps")
    items = []
    while not cell.endswith("nil"):
        own = {p.rsplit("#")[-1]: o for a, p, o, *_ in rows if a == cell}
        items, cell = [*items, own["first"]], own["rest"]
    assert items == ["x", "y"]
    (tmp_path / "g.jsonld").write_text(json.dumps(LD, indent=2))
    assert rdf.read(spark, str(tmp_path / "g.jsonld")).count() == len(rows)
    with pytest.raises(ValueError):
        rdf.expanded({"@context": "https://elsewhere.example", "name": "x"})


def test_stores_manifests_and_contracts(spark, tmp_path):
    g = triples.of_rows(spark, [("urn:a", "schema:name", "A"), ("urn:a", "kb:memberOf", "urn:b")])
    for store in (stores.FolderStore(spark, str(tmp_path / "s")), stores.MemoryStore()):
        assert not store.exists("x/g.nt")
        store.save("x/g.nt", g)
        assert sorted(map(str, store.load("x/g.nt").collect())) == sorted(map(str, g.collect())) and store.exists("x/g.nt")
        store.delete("x/g.nt")
        with pytest.raises(FileNotFoundError):
            store.load("x/g.nt")
    with pytest.raises(ValueError):
        stores.FolderStore(spark, str(tmp_path)).path("../up")
    sources = spark.createDataFrame([("b.md", "2", 1), ("a.md", "1", 1), ("b.md", "3", 2)], "path string, content string, n int")
    kept = ingest.manifest(sources, order="n")
    assert ingest.plan(kept, sources.where("n = 2 OR path = 'a.md'")).where("change = 'unchanged'").count() == 2
    stores.save_manifest(kept, str(tmp_path / "m"))
    assert sorted(map(tuple, stores.load_manifest(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, kept.collect()))
    profile = Profile(mode="any", types=("schema:Article",), facets=(("kb:kind", "x"),))
    for kind in ("json", "yaml"):
        text = stores.contract_text({"required": ["schema:name"], "facets": ["kb:kind"]}, profile, kind)
        stores.save_text(spark, text, str(tmp_path / f"c.{kind}"))
        assert stores.read_contract(stores.load_text(spark, str(tmp_path / f"c.{kind}"))) == (shapes.contract(["schema:name"], ["kb:kind"]), profile)


def test_snapshots_come_back(spark):
    g = triples.of_rows(spark, [("urn:a", "schema:name", "A"), ("urn:a", "kb:memberOf", "urn:b")])
    nodes, edges = rdf.snapshot(g)
    assert sorted(map(str, rdf.from_snapshot(nodes, edges).collect())) == sorted(map(str, g.collect()))
    with pytest.raises(Exception, match="no absolute predicate"):
        rdf.from_snapshot(nodes, edges.selectExpr("s", "'plain' AS p", "o")).collect()


def test_blocks():
    text = "# Head\npara one\nstill one\n\n- a\n- b\n\n  more of b\n- c\n\n> quoted\n> on\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n\nmore\n```\nafter\n\n    indented\n\n    code\n\n---\n<div>\nhtml\n</div>\n\nend"
    assert documents.blocks(text) == ["# Head", "para one\nstill one", "- a\n- b\n\n  more of b\n- c", "> quoted\n> on", "| x | y |\n|---|---|\n| 1 | 2 |", "```py\ncode\n\nmore\n```", "after", "    indented\n\n    code", "---", "<div>\nhtml\n</div>", "end"]
    assert documents.blocks("") == [] and documents.blocks("\n\n") == []


def test_subword_distances_of_any_tokenizer(spark):
    docs = spark.createDataFrame([(1, "abc abd"), (2, "xyz"), (3, ""), (4, None)], "doc_id int, text string")
    split = terms.subwords(lambda texts: [[ord(c) for c in t if c != " "] for t in texts])
    for kind in ("tf", "binary", "tfidf"):
        got = {r["doc_id"]: r["distance"] for r in terms.subword_distance(docs, "abc abd", split, 4, kind).collect()}
        assert got == {1: 0.0, 2: 1.414214, 3: 1.0, 4: 1.0}
        rows = terms.weights(docs, kind, split=split).collect()
        assert abs(sum(r["weight"] ** 2 for r in rows if r["doc_id"] == 1) - 1) < 1e-9
    assert sorted(map(tuple, terms.subword_distance(docs, "a b", lambda c: terms.X.tokens(c), 2).collect())) == sorted(map(tuple, terms.token_distance(docs, "a b", 2).collect()))


def test_passages_in_blocks(spark):
    docs = spark.createDataFrame([(i, f"text number {i} ends") for i in range(30)], "doc_id int, text string")
    passages = spark.createDataFrame([(i, f"NUMBER {i} ") for i in range(40)], "item_id int, text string")
    want = sorted((i, i) for i in range(30))
    assert sorted(map(tuple, documents.containing(docs, passages).collect())) == sorted(map(tuple, documents.containing(docs, passages, most=7).collect())) == want


def test_one_document_by_its_fields(spark):
    g = build.of_fields(spark, "urn:d", "Title", ["x", " y "], assertions=[("Ann", "mentions", "Spark", 0.5, "c1", 3, 9)])
    by = {(r["p"].rsplit(":", 1)[-1].rsplit("/", 1)[-1].rsplit("#", 1)[-1]): r["o"] for r in g.collect()}
    assert by["keywords"] == "x, y" and by["confidence"] == "0.5" and by["startOffset"] == "3" and by["mentions"].endswith("id/spark")
    assert build.document_id(".hidden.md", "", {}, None, "urn:/") != build.document_id("hidden.md", "", {}, None, "urn:/")


def test_changes_back_to_an_earlier_text_are_seen(spark, tmp_path):
    seen, src = [], tmp_path / "in"
    src.mkdir()
    for n, content in enumerate(["A", "B", "A", "A"]):
        (src / f"{n}.json").write_text(json.dumps({"path": "x.md", "content": content}))
        stream = spark.readStream.schema("path string, content string").json(str(src))
        ingest.ingest(stream, str(tmp_path / "m"), lambda df: seen.extend(r["content"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["A", "B", "A"]
    ingest.compact(spark, str(tmp_path / "m"), str(tmp_path / "m2"))
    assert spark.read.parquet(str(tmp_path / "m2")).count() == 1


def test_fragments_are_followed_to_the_last_page(spark):
    h = "http://www.w3.org/ns/hydra/core#"
    pages = {f"https://t.example/?page={i}": {"@graph": [{"@id": f"urn:s{i}", "urn:p": [f"v{i}"]}, {"@id": f"https://t.example/?page={i}", h + "totalItems": 3, "urn:about": "the page", **({h + "next": {"@id": f"?page={i + 1}"}} if i < 3 else {})}]} for i in (1, 2, 3)}
    g = fragments.read(spark, "https://t.example/", [{"page": "1"}], get=pages.__getitem__)
    assert sorted((r["s"], r["o"]) for r in g.collect()) == [("urn:s1", "v1"), ("urn:s2", "v2"), ("urn:s3", "v3")]


def test_a_result_that_takes_too_long_is_cancelled(spark):
    slow = spark.range(4).repartition(4).mapInPandas(lambda batches: (time.sleep(20) or b for b in batches), "id long")
    with pytest.raises(TimeoutError):
        bank.collected(slow, 2)
    assert len(bank.collected(spark.range(3))) == 3
    g = bank.KnowledgeGraph(triples.empty(spark))
    assert set(g.services(("urn:a", g), ("urn:b", g))) == {"urn:a", "urn:b"}
    for wrong in ([("urn:a", g), ("urn:a", g)], [("plain", g)]):
        with pytest.raises(ValueError):
            g.services(*wrong)


def test_lines_with_long_literals_and_code_points(spark, tmp_path):
    long = 'a "quoted" \\ part\n' * 20_000
    g = triples.of_rows(spark, [("urn:a", "schema:text", long), ("urn:a", "schema:name", "x")])
    rdf.write(g, str(tmp_path / "g.nt"))
    assert sorted(map(str, rdf.read(spark, str(tmp_path / "g.nt")).collect())) == sorted(map(str, g.collect()))
    (tmp_path / "u.nt").write_text('<urn:a> <urn:p> "caf\\u00e9 \\"q\\"" .\n<urn:a> <urn:p> "plain"@en <urn:g> .\n')
    assert {(r["o"], r["o_lang"]) for r in rdf.read(spark, str(tmp_path / "u.nt")).collect()} == {('café "q"', None), ("plain", "en")}
    (tmp_path / "bad.nt").write_text('<urn:a> <urn:p> "one" "two" .\n')
    with pytest.raises(Exception, match="bad line"):
        rdf.read(spark, str(tmp_path / "bad.nt")).collect()
