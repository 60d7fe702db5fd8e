import json

import pytest

from graphloom.bank import KnowledgeBank
from graphloom.operators import facts
from graphloom.sources import files

ANSWERS = {
    "one": {"entities": [{"label": "Spark", "type": "schema:SoftwareApplication", "sameAs": ["https://x.org/spark"]}, {"label": " "}, {"label": "Ann", "type": "schema:Person"}], "assertions": [{"s": "<ARTICLE_ID>", "p": "mentions", "o": "Spark", "confidence": 0.7, "source": "__SOURCE__"}, {"s": "Ann", "p": "schema:creator", "o": "Apache Spark", "confidence": "nan"}, {"s": "", "p": "about", "o": "x"}, {"s": "Ann", "p": "no such word", "o": "x"}]},
    "two": {"entities": [{"label": "Apache Spark", "sameAs": ["HTTPS://X.org/spark"]}, {"label": "spark"}], "assertions": [{"s": "<ARTICLE_ID>", "p": "mentions", "o": "spark", "confidence": 9}, {"s": "ann", "p": "schema:creator", "o": "Apache Spark", "confidence": 0.9}]},
}


def model(doc, text):
    if "broken" in text:
        return "{not json"
    return "```json\n" + json.dumps(ANSWERS[text.strip()]) + "\n```"


def test_extraction_and_merge(spark):
    chunks = spark.createDataFrame([("urn:d1", 0, "one"), ("urn:d2", 0, "two"), ("urn:d2", 1, " "), ("urn:d3", 0, "broken")], "doc_id string, ord long, text string")
    answers = facts.extract(chunks, model)
    assert sorted((r["doc_id"], r["payload"] is None) for r in answers.collect()) == [("urn:d1", False), ("urn:d2", False), ("urn:d3", True)]
    found = facts.parsed(answers)
    entities, assertions, sources = facts.merge(facts.entity_rows(found), facts.assertion_rows(found))
    by = {r["id"]: r for r in entities.collect()}
    spark_id, ann = "urn:graphloom:/id/spark", "urn:graphloom:/id/ann"
    assert by.keys() == {spark_id, ann}
    assert by[spark_id]["label"] == "Apache Spark" and by[spark_id]["type"] == "schema:SoftwareApplication" and by[spark_id]["source"] == "urn:d1"
    assert {r["source"] for r in sources.where(f"id = '{spark_id}'").collect()} == {"urn:d1", "urn:d2"}
    told = {(r["s"], r["p"].rsplit("/", 1)[-1], r["o"]): r["confidence"] for r in assertions.collect()}
    assert told == {("urn:d1", "mentions", spark_id): 0.7, ("urn:d2", "mentions", spark_id): 1.0, (ann, "creator", spark_id): 0.9}
    g = facts.as_triples(entities, assertions, sources)
    assert g.where(f"s = '{spark_id}' AND p LIKE '%confidence'").count() == 1 and g.where("p LIKE '%wasDerivedFrom'").count() == sources.count()


def test_only_new_chunks_are_asked(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def counted(doc, text):
        asked.add(1)
        return {"entities": [{"label": text}]}

    rows = lambda *texts: spark.createDataFrame([("urn:d", i, t) for i, t in enumerate(texts)], "doc_id string, ord long, text string")
    cache = str(tmp_path / "cache")
    assert facts.cached(rows("a", "b"), counted, cache, "prompt 1").count() == 2 and asked.value == 2
    again = facts.cached(rows("b", "c", "a"), counted, cache, "prompt 1").collect()
    assert asked.value == 3 and sorted((r["ord"], json.loads(r["payload"])["entities"][0]["label"]) for r in again) == [(0, "b"), (1, "c"), (2, "a")]
    facts.cached(rows("a"), counted, cache, "prompt 2").collect()
    assert asked.value == 4


def test_a_build_with_a_model(spark):
    sources = files.inline(spark, [("notes/a.md", "one"), ("notes/b.md", "---\ntitle: open\nbroken front matter")])
    made = KnowledgeBank(spark).build(sources, model=model)
    assert made.graph.ask('ASK { ?a schema:mentions ?x . ?x schema:name "Spark" }')
    assert [r["path"] for r in made.problems.collect()] == ["notes/b.md"]
    with pytest.raises(Exception, match="closed"):
        KnowledgeBank(spark, made.options.__class__(strict=True)).build(sources).graph.triples.count()
