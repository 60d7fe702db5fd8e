"""What graphs at size move: stored text is compressed, orders are sorted once, concepts are broadcast."""

from graphloom.operators import triples
from graphloom.sources import rdf
from graphloom.sources.stores import FolderStore

ROWS = [("kb:a", "rdf:type", "kb:T"), ("kb:a", "schema:name", 'q"\\ü\n'), ("kb:a", "schema:name", "b"), ("kb:b", "kb:x", "kb:a"), ("kb:b", "rdf:type", "kb:T"), ("kb:b", "rdf:type", "kb:S"), ("kb:a", "rdf:type", "kb:T")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.select("s", "p", "o").collect()))


def test_stored_text_is_compressed_and_reads_back(spark, tmp_path):
    g = triples.of_rows(spark, ROWS)
    for name in ("whole.nt", "star.jsonl"):
        store = FolderStore(spark, str(tmp_path), "gzip")
        store.save(name, g)
        assert list((tmp_path / name).glob("*.txt.gz")) and not list((tmp_path / name).glob("*.txt"))
        assert rows(store.load(name).distinct()) == rows(g.distinct())


def test_nodes_as_json_take_one_shuffle(spark):
    lines = rdf.jsonld(triples.of_rows(spark, ROWS))
    assert plan(lines).count("Exchange") == 1
    assert {r["value"] for r in lines.collect()} == {
        '{"@id":"urn:graphloom:vocab:a","@type":["urn:graphloom:vocab:T"],"https://schema.org/name":[{"@value":"b","@type":"http://www.w3.org/2001/XMLSchema#string"},{"@value":"q\\"\\\\ü\\n","@type":"http://www.w3.org/2001/XMLSchema#string"}]}',
        '{"@id":"urn:graphloom:vocab:b","@type":["urn:graphloom:vocab:S","urn:graphloom:vocab:T"],"urn:graphloom:vocab:x":[{"@id":"urn:graphloom:vocab:a"}]}',
    }


def test_edges_are_numbered_without_a_second_sort(spark):
    g = triples.of_rows(spark, [(f"kb:n{i % 37}", "kb:x", f"kb:m{i}") for i in range(500)])
    out = rdf.numbered_edges(g)
    assert "Exchange hashpartitioning" not in plan(out).split("BroadcastExchange")[0] and "row_number" not in plan(out)
    got = sorted(map(tuple, out.select("n", "s", "p", "o").collect()))
    assert [x[1:] for x in got] == rows(g) and [x[0] for x in got] == list(range(1, 501))


def test_a_graph_is_not_shuffled_for_its_concepts(spark):
    g = triples.of_rows(spark, [("kb:c", "skos:broader", "kb:d"), ("kb:d", "skos:broader", "kb:e"), ("kb:x", "kb:in", "kb:c"), ("kb:x", "kb:in", "kb:e"), ("kb:y", "kb:in", "kb:z")])
    new = triples.skos(g)
    assert "SortMergeJoin" not in plan(new).replace("SortMergeJoin [s", "", 1)
    K = "urn:graphloom:vocab:"
    assert [r for r in rows(new) if r[1] == K + "in"] == [(K + "x", K + "in", K + "d")]
