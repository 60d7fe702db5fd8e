"""Graph queries: SPARQL over tables mapped to triples, search, inference, shapes and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import entities, search, shapes, triples
from graphloom.operators.triples import BASE, PREFIXES, iri
from graphloom.plans.graph_sql import GRAPH
from graphloom.plans.registry import query, table
from graphloom.sparql import Engine

KB = PREFIXES["kb"]


def _star(spark, sf_dir, text: str, **services):
    return Engine(triples.star(spark, sf_dir), **services).select(text, limit=None)


def sparql(name: str, text: str, sql: str, corpus: bool = False):
    """Registers a query over the mapped tables."""

    @query(name, sql)
    def run(spark, sf_dir):
        g = triples.corpus(spark, sf_dir) if corpus else triples.star(spark, sf_dir)
        return Engine(g).select(text, limit=None)

    return run


def _num(df, *names: str):
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else c for c in df.columns])


sparql(
    "bgp_two_hop",
    "SELECT ?customer ?region WHERE { ?c a kb:Customer ; schema:name ?customer ; kb:memberOf ?n . ?n kb:memberOf ?r . ?r schema:name ?region }",
    "SELECT c_name AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
sparql(
    "bgp_star",
    "SELECT ?name ?brand ?size WHERE { ?p kb:brand ?brand ; kb:size ?size ; schema:name ?name . FILTER(?size >= 40) }",
    "SELECT p_name AS name, p_brand AS brand, p_size::VARCHAR AS size FROM part WHERE p_size >= 40",
)
sparql(
    "optional_label",
    "SELECT ?s ?label WHERE { ?s kb:memberOf ?n OPTIONAL { ?s rdfs:label ?label } OPTIONAL { ?s skos:prefLabel ?label } OPTIONAL { ?s schema:name ?label } }",
    f"SELECT '{BASE}nation/' || n_nationkey AS s, n_name AS label FROM nation UNION ALL SELECT '{BASE}supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT '{BASE}customer/' || c_custkey, c_name FROM customer",
)
sparql(
    "union_evidence",
    'SELECT ?x ?why WHERE { { ?x kb:segment "BUILDING" BIND("segment" AS ?why) } UNION { ?x kb:balance ?b FILTER(?b > 9000) BIND("balance" AS ?why) } }',
    f"SELECT '{BASE}customer/' || c_custkey AS x, 'segment' AS why FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT '{BASE}customer/' || c_custkey, 'balance' FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT '{BASE}supplier/' || s_suppkey, 'balance' FROM supplier WHERE s_acctbal > 9000",
)
sparql(
    "filter_not_exists",
    'SELECT ?c WHERE { ?c a kb:Customer FILTER NOT EXISTS { ?o schema:customer ?c ; kb:priority "1-URGENT" } }',
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
sparql(
    "values_bind",
    'SELECT ?name ?segment ?tag WHERE { VALUES ?segment { "BUILDING" "MACHINERY" } ?c kb:segment ?segment ; schema:name ?name BIND(CONCAT(LCASE(?segment), "-", STR(STRLEN(?name))) AS ?tag) }',
    "SELECT c_name AS name, c_mktsegment AS segment, lower(c_mktsegment) || '-' || length(c_name) AS tag FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
sparql(
    "select_order_limit",
    "SELECT DISTINCT ?name ?b WHERE { ?s a kb:Supplier ; schema:name ?name ; kb:balance ?b } ORDER BY DESC(?b) ?name LIMIT 7 OFFSET 3",
    "SELECT DISTINCT s_name AS name, s_acctbal::VARCHAR AS b FROM supplier ORDER BY s_acctbal DESC, name LIMIT 7 OFFSET 3".replace("DISTINCT s_name AS name, s_acctbal::VARCHAR AS b FROM supplier ORDER BY s_acctbal DESC, name", "name, b FROM (SELECT DISTINCT s_name AS name, s_acctbal AS x, s_acctbal::VARCHAR AS b FROM supplier) ORDER BY x DESC, name"),
)
sparql(
    "minus_pattern",
    'SELECT ?c WHERE { ?c a kb:Customer MINUS { ?c kb:segment "BUILDING" } MINUS { ?o schema:customer ?c ; kb:status "P" } }',
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
sparql(
    "path_sequence",
    "SELECT ?name WHERE { ?c kb:memberOf/kb:memberOf/schema:name ?r ; kb:balance ?b ; schema:name ?name FILTER(?r = \"ASIA\" && ?b < 0 || ?r = \"EUROPE\") }",
    "SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE (r_name = 'ASIA' AND c_acctbal < 0) OR r_name = 'EUROPE' UNION ALL SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE (r_name = 'ASIA' AND s_acctbal < 0) OR r_name = 'EUROPE'",
)
sparql(
    "path_inverse_alternative",
    "SELECT ?o ?end WHERE { ?c kb:segment \"FURNITURE\" ; ^schema:customer ?o . ?o kb:status|kb:priority ?end }",
    f"SELECT '{BASE}order/' || o_orderkey AS o, unnest([o_orderstatus, o_orderpriority]) AS \"end\" FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE'",
)
sparql(
    "path_plus",
    "SELECT ?a ?b WHERE { ?a kb:nextStep+ ?b }",
    f"SELECT '{BASE}turn/' || a.conv_id || '-' || a.turn AS a, '{BASE}turn/' || b.conv_id || '-' || b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn",
    corpus=True,
)


@query("sparql_group_count", "SELECT n_name AS nation, count(*)::DOUBLE AS customers, round(avg(c_acctbal), 4) AS balance, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 5")
def sparql_group_count(spark, sf_dir):
    out = _star(spark, sf_dir, "SELECT ?nation (COUNT(?c) AS ?customers) (AVG(?b) AS ?balance) (MAX(?b) AS ?most) WHERE { ?c a kb:Customer ; kb:balance ?b ; kb:memberOf/schema:name ?nation } GROUP BY ?nation HAVING (COUNT(?c) > 5)")
    return _num(out, "customers", "balance", "most").withColumn("balance", F.round("balance", 4))


@query("sparql_subselect", f"SELECT '{BASE}order/' || l_orderkey AS o, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200")
def sparql_subselect(spark, sf_dir):
    # a graph is a set, so the lines of one order with equal number, part and supplier count once: SUM runs over lines
    out = _star(spark, sf_dir, "SELECT ?o ?quantity WHERE { { SELECT ?o (SUM(?q) AS ?quantity) WHERE { ?o schema:hasPart ?l . ?l kb:quantity ?q } GROUP BY ?o } FILTER(?quantity > 200) }")
    return _num(out, "quantity")


@query("ask_exists", "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def ask_exists(spark, sf_dir):
    return Engine(triples.star(spark, sf_dir)).ask('ASK { ?o kb:total ?t ; kb:status "F" FILTER(?t > 400000) }')


@query("federated_join", "SELECT s_name AS supplier, c_name AS customer FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 9000")
def federated_join(spark, sf_dir):
    g = triples.star(spark, sf_dir)
    kept = lambda kind: g.where(F.startswith("s", F.lit(f"{BASE}{kind}/")))
    engine = Engine(triples.empty(spark), services={"urn:endpoint:suppliers": kept("supplier"), "urn:endpoint:customers": kept("customer")}, allowed={"urn:endpoint:suppliers", "urn:endpoint:customers", "urn:endpoint:gone"})
    return engine.select(
        """SELECT ?supplier ?customer WHERE {
        SERVICE <urn:endpoint:suppliers> { ?s schema:name ?supplier ; kb:memberOf ?n ; kb:balance ?x FILTER(?x > 9000) }
        SERVICE <urn:endpoint:customers> { ?c schema:name ?customer ; kb:memberOf ?n ; kb:balance ?y FILTER(?y > 9000) }
        SERVICE SILENT <urn:endpoint:gone> { ?z a ?t } }""",
        limit=None,
    )


# -- whole graphs


@query("doc_triples", f"""
SELECT s, p, o, kind FROM (SELECT '{BASE}document/' || doc_id AS s, unnest([
 {{p: '{iri("rdf:type")}', o: '{iri("schema:Article")}', kind: 'iri'}}, {{p: '{iri("schema:name")}', o: trim(string_split(text, chr(10))[1]), kind: 'literal'}},
 {{p: '{iri("schema:inLanguage")}', o: lang, kind: 'literal'}}, {{p: '{iri("kb:sourceProject")}', o: source, kind: 'literal'}},
 {{p: '{iri("prov:wasDerivedFrom")}', o: '{BASE}document/' || doc_id, kind: 'iri'}}], recursive := true) FROM documents) WHERE o IS NOT NULL""")
def doc_triples(spark, sf_dir):
    g = triples.corpus(spark, sf_dir)
    wanted = [iri(p) for p in ("rdf:type", "schema:name", "schema:inLanguage", "kb:sourceProject", "prov:wasDerivedFrom")]
    return g.where(F.col("p").isin(wanted) & (F.startswith("s", F.lit(f"{BASE}document/")))).select("s", "p", "o", F.col("o_kind").alias("kind"))


_CENSUS = {"Region": "region", "Nation": "nation", "Supplier": "supplier", "Customer": "customer", "Order": "orders"}


@query("schema_types", " UNION ALL ".join(f"SELECT '{KB}{k}' AS type, count(*) AS n FROM {t}" for k, t in _CENSUS.items()) + f" UNION ALL SELECT '{KB}' || p_type, count(*) FROM part GROUP BY p_type")
def schema_types(spark, sf_dir):
    return triples.type_census(triples.star(spark, sf_dir))


def _census_sql() -> str:
    rows = [
        ("rdf:type", ["region", "nation", "supplier", "customer", "part", "orders"], False), ("schema:name", ["region", "nation", "supplier", "customer", "part"], True), ("kb:memberOf", ["nation", "supplier", "customer"], False),
        ("skos:broader", ["nation"], False), ("kb:balance", ["supplier", "customer"], True), ("kb:segment", ["customer"], True), ("kb:brand", ["part"], True), ("kb:size", ["part"], True), ("kb:price", ["part"], True), ("schema:customer", ["orders"], False),
        ("kb:status", ["orders"], True), ("kb:priority", ["orders"], True), ("kb:total", ["orders"], True), ("schema:hasPart", ["lineitem"], False), ("kb:part", ["lineitem"], False), ("kb:supplier", ["lineitem"], False), ("kb:quantity", ["lineitem"], True),
    ]
    one = lambda p, ts, lit: f"SELECT '{iri(p)}' AS predicate, n, {'n' if lit else '0::BIGINT'} AS n_literal, {'0::BIGINT' if lit else 'n'} AS n_resource FROM (SELECT ({' + '.join(f'(SELECT count(*) FROM {t})' for t in ts)})::BIGINT AS n)"
    return " UNION ALL ".join(one(*r) for r in rows)


@query("schema_predicates", _census_sql())
def schema_predicates(spark, sf_dir):
    return triples.predicate_census(triples.star(spark, sf_dir))


def _edited(g):
    """A later version: names of every tenth document marked, every seventeenth document gone."""
    number = F.substring_index("s", "/", -1).cast("bigint")
    name = F.when((F.col("p") == iri("schema:name")) & (number % 10 == 0), F.concat("o", F.lit(" (2)"))).otherwise(F.col("o"))
    return g.where(number % 17 != 0).withColumn("o", name)


def _doc_graph(spark, sf_dir):
    return triples.corpus(spark, sf_dir).where(F.col("p").isin(iri("schema:name"), iri("schema:inLanguage")))


_BEFORE = f"a AS (SELECT DISTINCT '{BASE}document/' || doc_id AS s, doc_id, '{iri('schema:name')}' AS p, trim(string_split(text, chr(10))[1]) AS o FROM documents UNION SELECT '{BASE}document/' || doc_id, doc_id, '{iri('schema:inLanguage')}', lang FROM documents)"
_AFTER = f"b AS (SELECT s, doc_id, p, CASE WHEN p = '{iri('schema:name')}' AND doc_id % 10 = 0 THEN o || ' (2)' ELSE o END AS o FROM a WHERE doc_id % 17 <> 0)"


@query("graph_diff", f"WITH {_BEFORE}, {_AFTER} SELECT s, p, o, 'removed' AS change FROM (SELECT s, p, o FROM a WHERE o IS NOT NULL EXCEPT SELECT s, p, o FROM b) UNION ALL SELECT s, p, o, 'added' FROM (SELECT s, p, o FROM b WHERE o IS NOT NULL EXCEPT SELECT s, p, o FROM a)")
def graph_diff(spark, sf_dir):
    g = _doc_graph(spark, sf_dir)
    return triples.edge_diff(g, _edited(g)).select("s", "p", "o", "change")


@query("graph_node_diff", f"SELECT DISTINCT '{BASE}document/' || doc_id AS node, 'removed' AS change FROM documents WHERE doc_id % 17 = 0")
def graph_node_diff(spark, sf_dir):
    g = _doc_graph(spark, sf_dir)
    return triples.node_diff(g, _edited(g))


@query("changed_literals", f"WITH {_BEFORE}, {_AFTER} SELECT a.s, a.p, a.o AS old, b.o AS new FROM a JOIN b USING (s, p) WHERE a.o <> b.o")
def changed_literals(spark, sf_dir):
    g = _doc_graph(spark, sf_dir)
    return triples.changed_literals(g, _edited(g))


@query("graph_merge", f"WITH {GRAPH} SELECT DISTINCT s, p, o, dt FROM g")
def graph_merge(spark, sf_dir):
    # the second graph shares the corpus with the first, and lines of one order can repeat
    whole = triples.union(triples.star(spark, sf_dir), triples.corpus(spark, sf_dir))
    merged = triples.merge(whole, triples.corpus(spark, sf_dir))
    return merged.select("s", "p", "o", F.replace("o_dt", F.lit(triples.XSD), F.lit("")).alias("dt"))


# -- inference


@query("rdfs_closure", f"SELECT DISTINCT '{BASE}part/' || p_partkey AS s, t AS o FROM part, (VALUES ('{KB}Part'), ('{KB}Thing')) x(t)")
def rdfs_closure(spark, sf_dir):
    parts = triples.star(spark, sf_dir).where((F.col("p") == triples.TYPE) & F.startswith("s", F.lit(f"{BASE}part/")))
    classes = parts.select("o").distinct().select(F.col("o").alias("s"), F.lit("iri").alias("s_kind"), F.lit(iri("rdfs:subClassOf")).alias("p"), F.lit(f"{KB}Part").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    schema = triples.of_rows(spark, [("kb:Part", "rdfs:subClassOf", "kb:Thing")])
    return triples.rdfs(triples.union(parts, classes, schema)).where((F.col("p") == triples.TYPE)).select("s", "o")


@query("skos_broader", f"SELECT DISTINCT '{BASE}supplier/' || s_suppkey AS s, '{iri('kb:memberOf')}' AS p, '{BASE}region/' || n_regionkey AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT DISTINCT '{BASE}customer/' || c_custkey, '{iri('kb:memberOf')}', '{BASE}region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def skos_broader(spark, sf_dir):
    return triples.skos(triples.star(spark, sf_dir)).select("s", "p", "o")


@query("rule_head", f"SELECT DISTINCT '{BASE}conversation/' || conv_id AS s, '{BASE}turn/' || conv_id || '-' || turn AS o FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role = 'user')")
def rule_head(spark, sf_dir):
    from graphloom.operators import rules

    g = triples.corpus(spark, sf_dir).where(F.col("p").isin(iri("schema:hasPart"), iri("kb:nextStep"), iri("kb:role")))
    rule = '{ ?c schema:hasPart ?t . ?t kb:role "user" ; kb:nextStep ?n } => { ?c kb:answeredBy ?n }'
    return rules.apply(g, [rule]).where(F.col("p") == iri("kb:answeredBy")).select("s", "o")


@query("alias_components", "SELECT DISTINCT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def alias_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    edges = docs.groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where("size(ids) > 1").select(F.explode(F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids") - 1).alias("b"))).alias("e")).select("e.a", "e.b")
    return triples.components(edges)


# -- search


@query("schema_search", f"""
WITH own AS (SELECT '{BASE}supplier/' || s_suppkey AS node_id, s_name AS t FROM supplier UNION ALL SELECT '{BASE}customer/' || c_custkey, c_name FROM customer),
rel AS (SELECT '{BASE}supplier/' || s_suppkey AS node_id, n_name AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT '{BASE}customer/' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT node_id, round(sum(score), 6) AS score, count(*) AS n_evidence FROM (SELECT node_id, CASE WHEN lower(t) = 'nation_7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM own WHERE contains(lower(t), 'nation_7')
 UNION ALL SELECT node_id, 0.7::DOUBLE * CASE WHEN lower(t) = 'nation_7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END FROM rel WHERE contains(lower(t), 'nation_7')) GROUP BY 1""")
def schema_search(spark, sf_dir):
    return search.schema_search(triples.star(spark, sf_dir), "NATION_7", search.Profile(types=("kb:Supplier", "kb:Customer")), k=None)


@query("schema_expansion", f"SELECT DISTINCT '{BASE}nation/' || s_nationkey AS node_id, '{iri('kb:memberOf')}' AS predicate, 0.75::DOUBLE AS score FROM supplier WHERE s_acctbal > 9000")
def schema_expansion(spark, sf_dir):
    g = triples.star(spark, sf_dir)
    rich = g.where((F.col("p") == iri("kb:balance")) & F.startswith("s", F.lit(f"{BASE}supplier/")) & (F.col("o").try_cast("double") > 9000)).select(F.col("s").alias("node_id"))
    return search.expansion(g, rich)


def _articles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    doc = triples.node("document", F.col("doc_id"))
    return triples.union(triples.branch(docs, doc, "rdf:type", F.lit(iri("schema:Article")), link=True), triples.branch(docs, doc, "kb:memberOf", triples.node("source", F.col("source")), link=True))


@query("focused_related", f"WITH p AS (SELECT DISTINCT d.doc_id, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1) SELECT DISTINCT '{BASE}document/' || doc_id AS node_id, 0.7::DOUBLE AS score, 'memberOf' AS reason FROM documents WHERE source IN (SELECT source FROM p) AND doc_id NOT IN (SELECT doc_id FROM p)")
def focused_related(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(triples.node("document", F.col("doc_id")).alias("node_id"))
    return search.related(_articles(spark, sf_dir), toxic, k=None)


@query("focused_next_steps", f"SELECT DISTINCT '{BASE}turn/' || a.conv_id || '-' || (a.turn + 1) AS node_id, 0.8::DOUBLE AS score FROM conversations a WHERE role = 'user' AND turn < (SELECT max(turn) FROM conversations b WHERE b.conv_id = a.conv_id)")
def focused_next_steps(spark, sf_dir):
    g = triples.corpus(spark, sf_dir)
    asked = g.where((F.col("p") == iri("kb:role")) & (F.col("o") == "user")).select(F.col("s").alias("node_id"))
    return search.next_steps(g, asked, k=None)


sparql("facet_filter", "SELECT ?d WHERE { ?d a schema:Article ; kb:quality 1 ; kb:toxic 0 ; schema:inLanguage \"en\" }", f"SELECT '{BASE}document/' || d.doc_id AS d FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND toxic = 0 AND lang = 'en'", corpus=True)


@query("citations", f"WITH m AS (SELECT '{BASE}document/' || doc_id AS node_id, round(n_chars / 1000.0::DOUBLE, 6) AS score FROM documents WHERE n_chars > 20000) SELECT node_id, node_id AS document, score, row_number() OVER (ORDER BY score DESC, node_id) AS \"index\" FROM m QUALIFY \"index\" <= 5")
def citations(spark, sf_dir):
    matches = table(spark, sf_dir, "documents").where("n_chars > 20000").select(triples.node("document", F.col("doc_id")).alias("node_id"), F.round(F.col("n_chars") / F.lit(1000.0), 6).alias("score"))
    return search.citations(matches, triples.corpus(spark, sf_dir), k=5)


@query("entity_search", f"SELECT '{BASE}supplier/' || s_suppkey AS node_id, s_name AS name, '{KB}Supplier' AS types FROM supplier WHERE contains(lower(s_name), '7') UNION ALL SELECT '{BASE}customer/' || c_custkey, c_name, '{KB}Customer' FROM customer WHERE contains(lower(c_name), '7') UNION ALL SELECT '{BASE}nation/' || n_nationkey, n_name, '{KB}Nation' FROM nation WHERE contains(lower(n_name), '7')")
def entity_search(spark, sf_dir):
    return entities.entities(triples.star(spark, sf_dir), "7", k=None)


@query("article_search", f"SELECT '{BASE}document/' || doc_id AS node_id, min(trim(string_split(text, chr(10))[1])) AS name, '{iri('schema:Article')}' AS types FROM documents WHERE contains(lower(trim(string_split(text, chr(10))[1])), 'ther') GROUP BY doc_id")
def article_search(spark, sf_dir):
    return entities.articles(triples.corpus(spark, sf_dir), "ther", k=None)


@query("articles_by_entity", f"SELECT '{BASE}document/' || doc_id AS node_id, min(trim(string_split(text, chr(10))[1])) AS name FROM documents WHERE lower(lang) = 'fr' GROUP BY doc_id")
def articles_by_entity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    doc, lang = triples.node("document", F.col("doc_id")), triples.node("lang", F.col("lang"))
    g = triples.union(triples.corpus(spark, sf_dir), triples.branch(docs, doc, "schema:about", lang, link=True), triples.branch(docs.select("lang").distinct(), lang, "schema:name", F.col("lang")))
    return entities.articles_by_entity(g, "FR", k=None)


# -- shapes

_BASE_DOC = f"'{BASE}document/' || doc_id AS focus"


@query("shacl_min_count", f"SELECT 'labelled' AS shape, {_BASE_DOC}, '{iri('kb:quality')}' AS path, 'minCount' AS message, '0' AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def shacl_min_count(spark, sf_dir):
    return shapes.validate(triples.corpus(spark, sf_dir), [shapes.Shape("labelled", "kb:quality", "schema:Article", min_count=1)])


@query("shacl_max_count", f"SELECT 'few parts' AS shape, '{BASE}conversation/' || conv_id AS focus, '{iri('schema:hasPart')}' AS path, 'maxCount' AS message, count(*)::VARCHAR AS value FROM conversations GROUP BY conv_id HAVING count(*) > 4")
def shacl_max_count(spark, sf_dir):
    return shapes.validate(triples.corpus(spark, sf_dir), [shapes.Shape("few parts", "schema:hasPart", target_subjects_of="schema:hasPart", max_count=4)])


@query("shacl_range", f"SELECT 'balance' AS shape, '{BASE}customer/' || c_custkey AS focus, '{iri('kb:balance')}' AS path, CASE WHEN c_acctbal < 0 THEN 'minInclusive' ELSE 'maxInclusive' END AS message, round(c_acctbal, 2) AS value FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def shacl_range(spark, sf_dir):
    return _num(shapes.validate(triples.star(spark, sf_dir), [shapes.Shape("balance", "kb:balance", "kb:Customer", least=0, most=9000)]), "value")


@query("shacl_node_kind", f"SELECT 'members' AS shape, focus, '{iri('kb:memberOf')}' AS path, 'nodeKind' AS message, value FROM (SELECT '{BASE}nation/' || n_nationkey AS focus, '{BASE}region/' || n_regionkey AS value FROM nation)")
def shacl_node_kind(spark, sf_dir):
    return shapes.validate(triples.star(spark, sf_dir), [shapes.Shape("members", "kb:memberOf", "kb:Nation", node_kind="literal")])
