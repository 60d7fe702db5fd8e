import pytest

from graphloom.operators import rules, triples
from graphloom.sparql import Engine, QueryError, parse


@pytest.fixture(scope="module")
def g(spark):
    rows = [
        ("kb:a", "rdf:type", "schema:Article"), ("kb:b", "rdf:type", "schema:Article"), ("kb:c", "rdf:type", "kb:Note"),
        ("kb:a", "schema:name", "Alpha"), ("kb:b", "schema:name", "Beta"), ("kb:c", "rdfs:label", "Gamma"),
        ("kb:a", "kb:next", "kb:b"), ("kb:b", "kb:next", "kb:c"), ("kb:c", "kb:next", "kb:a"),
        ("kb:a", "kb:size", 5), ("kb:b", "kb:size", 10), ("kb:c", "kb:size", 2.5), ("kb:a", "kb:flag", True), ("kb:a", "kb:day", ("2024-05-06", "xsd:date")),
    ]
    return triples.of_rows(spark, rows).cache()


def rows(g, text, **options):
    return sorted(tuple(r) for r in Engine(g, **options).select(text, limit=None).collect())


SHORT = "urn:graphloom:vocab:"
CASES = [
    ("SELECT ?n WHERE { ?x a schema:Article ; schema:name ?n }", [("Alpha",), ("Beta",)]),
    ("SELECT ?n WHERE { ?x kb:size ?s . OPTIONAL { ?x schema:name ?n } OPTIONAL { ?x rdfs:label ?n } FILTER(?s < 6) }", [("Alpha",), ("Gamma",)]),
    ("SELECT ?x WHERE { ?x kb:next* kb:b . ?x kb:size ?s FILTER(?s = 2.5) }", [(SHORT + "c",)]),
    ("SELECT (COUNT(*) AS ?n) WHERE { ?a kb:next+ ?b }", [("9",)]),
    ("SELECT ?b WHERE { kb:a kb:next? ?b } ORDER BY ?b", [(SHORT + "a",), (SHORT + "b",)]),
    ("SELECT ?b WHERE { kb:a ^kb:next/schema:name|kb:next/schema:name ?b }", [("Beta",)]),
    ("SELECT ?p WHERE { kb:c !(rdf:type|kb:next|kb:size) ?p }", [("Gamma",)]),
    ("SELECT ?n WHERE { ?x schema:name ?n FILTER(REGEX(?n, '^alp', 'i') || STRLEN(?n) = 4) }", [("Alpha",), ("Beta",)]),
    ("SELECT ?t (SUM(?s) AS ?sum) (AVG(?s) AS ?avg) WHERE { ?x a ?t ; kb:size ?s } GROUP BY ?t HAVING (SUM(?s) > 5)", [("https://schema.org/Article", "15", "7.5")]),
    ("SELECT (GROUP_CONCAT(?n ; SEPARATOR=',') AS ?all) WHERE { ?x schema:name ?n }", [("Alpha,Beta",)]),
    ("SELECT ?x WHERE { ?x kb:size ?s FILTER(?s IN (5, 10)) FILTER NOT EXISTS { ?x kb:flag true } }", [(SHORT + "b",)]),
    ("SELECT ?x WHERE { ?x kb:size ?s FILTER(EXISTS { ?x kb:flag ?f } || ?s = 10) }", [(SHORT + "a",), (SHORT + "b",)]),
    ("SELECT ?x WHERE { ?x kb:size ?s FILTER NOT EXISTS { ?y kb:size ?t FILTER(?t > ?s) } }", [(SHORT + "b",)]),
    ("SELECT ?x ?y WHERE { ?x kb:size ?s OPTIONAL { ?x schema:name ?y FILTER(?s > 6) } FILTER(?s >= 5) }", [(SHORT + "a", None), (SHORT + "b", "Beta")]),
    ("SELECT ?y WHERE { kb:a kb:day ?d BIND(YEAR(?d) + 1 AS ?y) }", [("2025",)]),
    ("SELECT ?l WHERE { VALUES (?x ?l) { (kb:a 'one') (UNDEF 'all') } ?x kb:flag true }", [("all",), ("one",)]),
    ("SELECT ?z WHERE { ?x schema:name ?n BIND(IF(?n = 'Alpha', SUBSTR(?n, 2, 3), UCASE(STRBEFORE(?n, 'a'))) AS ?z) }", [("BET",), ("lph",)]),
    ("SELECT ?x WHERE { ?x kb:size ?s MINUS { ?x a schema:Article } }", [(SHORT + "c",)]),
    ("SELECT ?x WHERE { ?x kb:size ?s MINUS { ?q a schema:Article } FILTER(?s > 9) }", [(SHORT + "b",)]),
    ("SELECT DISTINCT ?k WHERE { ?x ?p ?o BIND(DATATYPE(?o) AS ?d) BIND(isNumeric(?o) AS ?k) FILTER(BOUND(?d)) }", [("false",), ("true",)]),
    ("SELECT ?n WHERE { { SELECT ?x WHERE { ?x kb:size ?s } ORDER BY DESC(?s) LIMIT 1 } ?x schema:name ?n }", [("Beta",)]),
    ("SELECT ?n WHERE { [ kb:flag true ; schema:name ?n ] }", [("Alpha",)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_answers(g, text, want):
    assert rows(g, text) == sorted(want, key=str) or rows(g, text) == want


def test_order_and_default_limit(spark, g):
    e = Engine(g)
    assert [r[0] for r in e.select("SELECT ?s WHERE { ?x kb:size ?s } ORDER BY DESC(?s)").collect()] == ["10", "5", "2.5"]
    many = triples.of_rows(spark, [(f"kb:n{i}", "kb:size", i) for i in range(150)])
    assert Engine(many).select("SELECT ?x WHERE { ?x kb:size ?s }").count() == 100
    assert Engine(many).select("SELECT ?x WHERE { ?x kb:size ?s } LIMIT 120").count() == 120
    assert e.ask("ASK { kb:a kb:flag true }").first()[0] and not e.ask("ASK { kb:b kb:flag true }").first()[0]


@pytest.mark.parametrize("text", ["INSERT DATA { kb:a kb:b kb:c }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "DELETE WHERE { ?s ?p ?o }", "SELECT ?x WHERE { ?x nope:b ?y }", "SELECT ?x WHERE { ?x kb:b ?y", "SELECT ?x WHERE { SERVICE ?e { ?x kb:b ?y } }", "DESCRIBE kb:a"])
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def test_words_of_updates_in_strings_are_harmless(g):
    assert rows(g, "SELECT ?x WHERE { ?x schema:name 'DELETE' } # DROP all") == []


def test_federation(spark, g):
    other = triples.of_rows(spark, [("kb:a", "kb:colour", "red")])
    text = "SELECT ?n ?c WHERE { ?x schema:name ?n SERVICE <urn:e:1> { ?x kb:colour ?c } }"
    assert rows(g, text, services={"urn:e:1": other}) == [("Alpha", "red")]
    with pytest.raises(QueryError):
        rows(g, text)
    with pytest.raises(QueryError):
        rows(g, text, services={"urn:e:1": other}, allowed=set())
    assert len(rows(g, text.replace("SERVICE", "SERVICE SILENT"))) == 2


def test_rules_reach_a_fixpoint(g):
    out = rules.apply(g, ["{ ?a kb:next ?b } => { ?a kb:reaches ?b }", "{ ?a kb:reaches ?b . ?b kb:reaches ?c } => { ?a kb:reaches ?c }"])
    assert out.where("p = 'urn:graphloom:vocab:reaches'").count() == 9


def test_constant_predicates_leave_one_scan(spark):
    g = triples.star(spark, "/root/testdata/sf0.001")
    plan = Engine(g).select("SELECT ?b WHERE { ?s kb:segment ?b }")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "c_mktsegment" in plan and "c_acctbal" not in plan
