"""Queries over Markdown notes written from all documents, over facts of a model, and over whole search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import build, documents, facts, search, shapes, terms, triples
from graphloom.operators.lineage import written
from graphloom.operators.triples import BASE, COLUMNS, iri
from graphloom.plans.graph_sql import GRAPH
from graphloom.plans.registry import query, table
from graphloom.sources import rdf
from graphloom.sparql import Engine

# the same notes for both sides
_BODY = "concat('opening ', w, '\n\n# Part ', CAST(doc_id % 5 AS STRING), '\nbody of ', w, '\n\n## Links\nsee [next](../x/n', CAST(doc_id + 1 AS STRING), '.md#top) and [[Page ', CAST(doc_id % 7 AS STRING), ']]\n')"
_HEAD = "concat('---\ntitle: Note ', CAST(doc_id AS STRING), '\ntags: [', lang, ', ', lang, ', notes]\nsummary: From ', source, '\ngraph_groups:\n  - ', lang, ' group\n---\n')"
_NOTES = "n AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')) AS w FROM documents)"
_DOC = f"'{BASE}' || source || '/n' || doc_id || '/'"
_GROUP = f"'{BASE}id/' || lang || '-group'"


def _notes(spark, sf_dir):
    # split and joined: replacing takes four times as long where there is much to replace
    w = table(spark, sf_dir, "documents").withColumn("w", F.trim(F.array_join(F.split("text", "[^A-Za-z ]", -1), " ")))
    return w.select("doc_id", F.expr("concat('content/', source, '/n', CAST(doc_id AS STRING), '.md')").alias("path"), F.expr(_BODY).alias("body"), F.expr(f"concat({_HEAD}, {_BODY})").alias("content"))


def _graph(spark, sf_dir):
    # as a set, written once: what is built on it reads it several times
    return written(build.authored(_notes(spark, sf_dir).select("path", "content")).dropDuplicates(COLUMNS))


_SECTIONS = f"""{_NOTES}, s AS (
 SELECT doc_id, 0 AS ord, 0 AS level, NULL AS heading, '' AS path, trim('opening ' || w) AS text FROM n UNION ALL
 SELECT doc_id, 1, 1, 'Part ' || doc_id % 5, 'Part ' || doc_id % 5, trim('body of ' || w) FROM n UNION ALL
 SELECT doc_id, 2, 2, 'Links', 'Part ' || doc_id % 5 || '>Links', 'see [next](../x/n' || (doc_id + 1) || '.md#top) and [[Page ' || doc_id % 7 || ']]' FROM n)"""


@query("note_sections", f"WITH {_SECTIONS} SELECT doc_id, ord::BIGINT AS ord, level, heading, path, text FROM s")
def note_sections(spark, sf_dir):
    return documents.sections(_notes(spark, sf_dir), text_col="body").withColumn("path", F.array_join("path", ">"))


@query("note_section_chunks", f"WITH {_SECTIONS} SELECT doc_id, ord::BIGINT AS ord, path, text, greatest(1, length(text) // 4)::BIGINT AS tokens FROM s")
def note_section_chunks(spark, sf_dir):
    return documents.chunks(_notes(spark, sf_dir), documents.whole_sections, text_col="body").select("doc_id", "ord", F.array_join("path", ">").alias("path"), "text", "tokens")


@query("note_links", f"""WITH {_NOTES} SELECT doc_id, 0::BIGINT AS ord, 'link' AS kind, 'next' AS label, '../x/n' || (doc_id + 1) || '.md#top' AS target, 'content/x/n' || (doc_id + 1) || '/#top' AS resolved, FALSE AS external FROM n
UNION ALL SELECT doc_id, 1, 'wiki', 'Page ' || doc_id % 7, 'Page ' || doc_id % 7, 'page-' || doc_id % 7 || '/', FALSE FROM n""")
def note_links(spark, sf_dir):
    return documents.links(_notes(spark, sf_dir), text_col="body", path_col="path")


_TRIPLES = f"""{_NOTES}, t AS (
 SELECT {_DOC} AS s, '{triples.TYPE}' AS p, '{iri("schema:Article")}' AS o, 'iri' AS k FROM n UNION SELECT {_DOC}, '{iri("schema:name")}', 'Note ' || doc_id, 'literal' FROM n UNION
 SELECT {_DOC}, '{iri("prov:wasDerivedFrom")}', {_DOC}, 'iri' FROM n UNION SELECT {_DOC}, '{iri("schema:description")}', 'From ' || source, 'literal' FROM n UNION
 SELECT {_DOC}, '{iri("schema:keywords")}', lang, 'literal' FROM n UNION SELECT {_DOC}, '{iri("schema:keywords")}', 'notes', 'literal' FROM n UNION
 SELECT {_DOC}, '{iri("kb:memberOf")}', {_GROUP}, 'iri' FROM n UNION SELECT {_GROUP}, '{triples.TYPE}', '{iri("schema:DefinedTerm")}', 'iri' FROM n UNION
 SELECT {_GROUP}, '{iri("schema:name")}', lang || ' group', 'literal' FROM n UNION SELECT {_GROUP}, '{iri("prov:wasDerivedFrom")}', {_DOC}, 'iri' FROM n)"""


@query("note_triples", f"WITH {_TRIPLES} SELECT s, p, o, k FROM t")
def note_triples(spark, sf_dir):
    return _graph(spark, sf_dir).select("s", "p", "o", F.col("o_kind").alias("k")).distinct()


_SCHEME = f"'{BASE}concepts'"


@query("note_concepts", f"""WITH {_TRIPLES}, c AS (SELECT DISTINCT o AS s FROM t WHERE p = '{iri("kb:memberOf")}')
SELECT {_SCHEME} AS s, '{triples.TYPE}' AS p, '{iri("skos:ConceptScheme")}' AS o UNION ALL SELECT s, '{triples.TYPE}', '{iri("skos:Concept")}' FROM c
UNION ALL SELECT s, '{iri("skos:inScheme")}', {_SCHEME} FROM c UNION ALL SELECT s, '{iri("skos:topConceptOf")}', {_SCHEME} FROM c UNION ALL SELECT {_SCHEME}, '{iri("skos:hasTopConcept")}', s FROM c
UNION ALL SELECT t.s, '{iri("skos:prefLabel")}', o FROM t JOIN c USING (s) WHERE p = '{iri("schema:name")}'""")
def note_concepts(spark, sf_dir):
    return build.concepts(_graph(spark, sf_dir)).select("s", "p", "o")


@query("note_ontology_documents", f"WITH {_TRIPLES} SELECT s, '{iri('kb:MarkdownDocument')}' AS o FROM t WHERE o = '{iri('schema:Article')}'")
def note_ontology_documents(spark, sf_dir):
    made = build.ontology(_graph(spark, sf_dir))
    return made.where(F.col("o") == iri("kb:MarkdownDocument")).select("s", "o")


_RDF = triples.PREFIXES["rdf"]


@query("note_statements", f"""WITH {_TRIPLES}, l AS (SELECT '_:st' || substr(sha256(s || chr(10) || p || chr(10) || o), 1, 16) AS st, s, p, o FROM t WHERE k = 'iri' AND p <> '{triples.TYPE}')
SELECT st AS s, '{triples.TYPE}' AS p, '{_RDF}Statement' AS o FROM l UNION ALL SELECT st, '{_RDF}subject', s FROM l UNION ALL SELECT st, '{_RDF}predicate', p FROM l UNION ALL SELECT st, '{_RDF}object', o FROM l UNION ALL SELECT st, '{iri("kb:confidence")}', '1.0' FROM l""")
def note_statements(spark, sf_dir):
    return build.reified(_graph(spark, sf_dir)).select("s", "p", "o")


@query("search_candidates", f"""WITH {_TRIPLES} SELECT {_DOC} AS node_id, 'Note ' || doc_id AS label, 'From ' || source AS description, 'Note ' || doc_id || chr(10) || 'From ' || source || chr(10) AS text FROM n
UNION ALL SELECT DISTINCT {_GROUP}, lang || ' group', NULL, lang || ' group' || chr(10) FROM n""")
def search_candidates(spark, sf_dir):
    return search.candidates(_graph(spark, sf_dir)).select("node_id", "label", "description", F.concat(F.rtrim(F.col("text"), F.lit("\n")), F.lit("\n")).alias("text"))


@query("document_candidates", f"""WITH {_SECTIONS} SELECT {_DOC.replace('doc_id', 'n.doc_id')} AS node_id, 'Note ' || n.doc_id || chr(10) || 'From ' || source || chr(10) || a.text || chr(10) || b.path || chr(10) || b.text || chr(10) || replace(c.path, '>', chr(10)) || chr(10) || c.text AS text
FROM n JOIN s a ON a.doc_id = n.doc_id AND a.ord = 0 JOIN s b ON b.doc_id = n.doc_id AND b.ord = 1 JOIN s c ON c.doc_id = n.doc_id AND c.ord = 2""")
def document_candidates(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    own = documents.chunks(notes, documents.whole_sections, "path", "body").withColumnRenamed("doc_id", "path_").join(build.named(notes.select("path", "content")).select(F.col("path").alias("path_"), "doc_id"), "path_")
    found = search.document_candidates(search.candidates(_graph(spark, sf_dir)), own)
    # lines of nothing come from a head that is missing
    return found.where(F.startswith("label", F.lit("Note "))).select("node_id", F.regexp_replace("text", "\n{2,}", "\n").alias("text"))


@query("document_scope", f"WITH {_TRIPLES} SELECT DISTINCT node_id FROM (SELECT {_DOC} AS node_id FROM n WHERE lang = 'de' UNION ALL SELECT {_GROUP} FROM n WHERE lang = 'de')")
def document_scope(spark, sf_dir):
    g = _graph(spark, sf_dir)
    german = g.where((F.col("p") == iri("schema:keywords")) & (F.col("o") == "de")).select(F.col("s").alias("node_id"))
    return search.in_scope(g, german)


@query("focused_subgraph", f"WITH {_TRIPLES}, d AS (SELECT {_DOC} AS s FROM n WHERE lang = 'fr') SELECT s, p, o FROM t JOIN d USING (s) WHERE k = 'literal' OR p IN ('{iri('prov:wasDerivedFrom')}', '{iri('kb:memberOf')}')")
def focused_subgraph(spark, sf_dir):
    g = _graph(spark, sf_dir)
    french = g.where((F.col("p") == iri("schema:keywords")) & (F.col("o") == "fr")).select(F.col("s").alias("node_id"))
    return search.subgraph(g, french).select("s", "p", "o")


# -- facts


def _sizes(doc, text):
    """A model that finds one entity by the length of a text."""
    label = f"Size {len(text) // 1000}"
    return {"entities": [{"label": label}], "assertions": [{"s": "<ARTICLE_ID>", "p": "mentions", "o": label, "confidence": len(text) % 30 / 10}]}


@query("model_facts", f"""WITH d AS (SELECT DISTINCT '{BASE}document/' || doc_id AS doc, '{BASE}id/size-' || length(text) // 1000 AS node, 'Size ' || length(text) // 1000 AS label FROM documents WHERE trim(text) <> '')
SELECT DISTINCT node AS s, '{triples.TYPE}' AS p, '{iri("schema:Thing")}' AS o FROM d UNION ALL SELECT DISTINCT node, '{iri("schema:name")}', label FROM d UNION ALL SELECT DISTINCT node, '{iri("kb:confidence")}', '1.0' FROM d
UNION ALL SELECT DISTINCT node, '{iri("prov:wasDerivedFrom")}', doc FROM d UNION ALL SELECT doc, '{iri("prov:wasDerivedFrom")}', doc FROM d UNION ALL SELECT doc, '{iri("schema:mentions")}', node FROM d""")
def model_facts(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(triples.node("document", F.col("doc_id")).alias("doc_id"), F.lit(0).alias("ord"), "text")
    found = written(facts.parsed(facts.extract(chunks, _sizes)))  # entities and assertions are read apart
    return facts.as_triples(*facts.merge(facts.entity_rows(found), facts.assertion_rows(found))).select("s", "p", "o")


@query("alias_rewrite", """
WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY doc_id % 50) AS head FROM documents)
SELECT 'urn:e:' || a.head AS s, 'urn:e:' || coalesce(b.head, a.doc_id + 1) AS o, max((a.doc_id % 10) / 10.0::DOUBLE) AS confidence FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id + 1 GROUP BY 1, 2""")
def alias_rewrite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = F.concat(F.lit("urn:e:"), F.col("doc_id"))
    entities = docs.select(own.alias("id"), F.lit("x").alias("label"), F.lit("schema:Thing").alias("type"), F.array(F.concat(F.lit("urn:k:"), F.col("doc_id") % 50)).alias("same_as"), F.lit(1.0).alias("confidence"), F.lit("").alias("source"), F.col("doc_id").alias("ordinal"))
    told = docs.select(own.alias("s"), F.lit(iri("schema:about")).alias("p"), F.concat(F.lit("urn:e:"), F.col("doc_id") + 1).alias("o"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.lit("").alias("source"), F.col("doc_id").alias("ordinal"))
    return facts.merge(entities, told)[1].select("s", "o", "confidence")


# -- whole search results

_EVIDENCE = f"""own AS (SELECT '{BASE}supplier/' || s_suppkey AS node, s_name AS t, 's' AS k, s_nationkey AS n FROM supplier UNION ALL SELECT '{BASE}customer/' || c_custkey, c_name, 'c', c_nationkey FROM customer),
ev AS (SELECT node, '{iri("schema:name")}' AS p, t AS text, 'direct' AS kind, NULL AS via, CASE WHEN lower(t) = 'nation_7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM own WHERE contains(lower(t), 'nation_7')
 UNION ALL SELECT node, '{iri("kb:memberOf")}', n_name, 'related', '{BASE}nation/' || n_nationkey, 0.7::DOUBLE * CASE WHEN lower(n_name) = 'nation_7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END FROM own JOIN nation ON n = n_nationkey WHERE contains(lower(n_name), 'nation_7'))"""
_PROFILE = search.Profile(types=("kb:Supplier", "kb:Customer"))


def _ranked(times: int) -> str:
    return f"""WITH {_EVIDENCE} SELECT node AS node_id, any_value(t) AS label, any_value(CASE k WHEN 's' THEN '{iri("kb:Supplier")}' ELSE '{iri("kb:Customer")}' END) AS types, round({times} * sum(score), 6) AS score, {times} * count(*) AS n_evidence, min(text) AS matched, min(via) AS via
FROM ev JOIN own USING (node) GROUP BY 1 ORDER BY score DESC, lower(label), node_id LIMIT 25"""


def _told(df):
    return df.select("node_id", "label", F.array_join("types", " ").alias("types"), "score", F.size("evidence").cast("bigint").alias("n_evidence"), F.array_min("evidence.matched_text").alias("matched"), F.array_min("evidence.via").alias("via"))


@query("schema_matches", _ranked(1))
def schema_matches(spark, sf_dir):
    return _told(search.schema_matches(triples.star(spark, sf_dir), "NATION_7", _PROFILE, 25))


@query("schema_matches_federated", _ranked(2))
def schema_matches_federated(spark, sf_dir):
    g = triples.star(spark, sf_dir)
    return _told(search.schema_matches({"urn:one": g, "urn:two": g}, "NATION_7", _PROFILE, 25))


@query("schema_explained", f"WITH {_EVIDENCE} SELECT DISTINCT node, p, text, kind FROM ev")
def schema_explained(spark, sf_dir):
    text = search.explain("NATION_7", search.Profile(types=("kb:Supplier", "kb:Customer"), excluded_types=()))
    return Engine(triples.star(spark, sf_dir)).select(text, limit=None).select("node", "p", "text", "kind")


@query("profile_problems", "SELECT 'predicate' AS kind, name FROM (VALUES " + ", ".join(f"('{iri(p)}')" for p in ("rdfs:label", "skos:prefLabel", "skos:altLabel", "schema:description", "schema:keywords", "schema:about", "schema:mentions", "kb:relatedTo", "kb:nextStep", "schema:isPartOf")) + ") v(name)")
def profile_problems(spark, sf_dir):
    return search.Profile().problems(triples.star(spark, sf_dir))


_SPLIT = r"[\s,.;:!?()\[\]{}\"'']+"


@query("context_overlap", rf"""WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '{_SPLIT}'), lambda x: length(x) >= 5)) AS w FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) >= 2 AS overlaps FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def context_overlap(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    before = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return talk.join(before, ["conv_id", "turn"]).select("conv_id", "turn", search.context_overlap(F.col("text"), F.col("before")).alias("overlaps"))


@query("best_chunks", rf"""
WITH l AS (SELECT doc_id, lang, trim(string_split(text, chr(10))[1]) AS label, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS t FROM documents),
s AS (SELECT doc_id, ord, t, greatest(CASE WHEN contains(lower(t), 'ther') THEN 4004 ELSE 0 END, CASE WHEN length(label) >= 3 AND contains(lower(t), lower(label)) THEN 2000 + length(label) ELSE 0 END) AS anchor FROM l WHERE lang = 'es')
SELECT '{BASE}document/' || doc_id AS node_id, ord, t AS text, anchor FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY anchor DESC, ord) = 1""")
def best_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    node = triples.node("document", F.col("doc_id"))
    matches = docs.where("lang = 'es'").select(node.alias("node_id"), F.trim(F.element_at(F.split("text", "\n"), 1)).alias("label"), F.lit(1.0).alias("score"))
    lines = docs.select(node.alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("ord", F.col("ord").cast("bigint"))
    return search.best_chunks(matches, triples.corpus(spark, sf_dir), lines, "ther").select("node_id", "ord", "text", F.col("anchor").cast("int").alias("anchor"))


@query("snapshot_round_trip", f"WITH {GRAPH} SELECT DISTINCT s, p, o, dt IS NOT NULL AS literal FROM g")
def snapshot_round_trip(spark, sf_dir):
    g = triples.union(triples.star(spark, sf_dir), triples.corpus(spark, sf_dir))
    return rdf.from_snapshot(*rdf.snapshot(g)).select("s", "p", "o", (F.col("o_kind") == "literal").alias("literal"))


@query("contract_shapes", f"""SELECT 'facet kb:quality' AS shape, '{BASE}document/' || doc_id AS focus, 'minCount' AS message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)
UNION ALL SELECT 'link kb:sourceProject', '{BASE}document/' || doc_id, 'nodeKind' FROM documents WHERE source IS NOT NULL""")
def contract_shapes(spark, sf_dir):
    return shapes.validate(triples.corpus(spark, sf_dir), shapes.contract(["schema:name"], ["kb:quality"], ["kb:sourceProject", "prov:wasDerivedFrom"])).select("shape", "focus", "message")


def _lengths(texts):
    return [[len(w) for w in t.split(" ") if w] for t in texts]


@query("subword_distance", """
WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x)) AS toks FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1, 2), n AS (SELECT count(*) AS n_all FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf.n * (ln((n_all + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term), n),
qw AS (SELECT term, c * (ln((n_all + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS qw FROM (VALUES (3, 2), (4, 1), (9, 1)) q(term, c) LEFT JOIN df USING (term), n),
s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, sum(w * coalesce(qw, 0)) AS dot FROM w LEFT JOIN qw USING (term) GROUP BY 1)
SELECT doc_id, round(CASE WHEN norm IS NULL THEN 1 ELSE sqrt(greatest(0, 2 - 2 * dot / norm / (SELECT sqrt(sum(qw * qw)) FROM qw))) END, 6) AS distance FROM t LEFT JOIN s USING (doc_id) ORDER BY distance, doc_id LIMIT 10""")
def subword_distance(spark, sf_dir):
    return terms.subword_distance(table(spark, sf_dir, "documents"), "the abc four ninewords", terms.subwords(_lengths), 10)
