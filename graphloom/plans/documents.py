"""Document queries: segments, chunks, coverage, manifests, facts, links, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import documents, triples
from graphloom.operators.lineage import shared_folder
from graphloom.operators.triples import BASE, PREFIXES, iri
from graphloom.plans.graph_sql import GRAPH
from graphloom.plans.registry import query, table
from graphloom.sources import rdf
from graphloom.sources.stores import FolderStore, load_manifest, save_manifest
from graphloom.streaming import ingest

TARGET = 120
_WIDE = X.WIDE
_LINES = r"lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"
_UNITS = f"length(line) + 5 * len(regexp_extract_all(line, '{_WIDE}'))"
_PACKED = f"""{_LINES}, sized AS (SELECT doc_id, i, line, {_UNITS} AS u FROM lines),
fold AS (SELECT doc_id, i, u AS held, 0 AS chunk FROM sized WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN greatest(1, (f.held + 1 + s.u) // 4) > {TARGET} THEN s.u ELSE f.held + 1 + s.u END,
         f.chunk + CASE WHEN greatest(1, (f.held + 1 + s.u) // 4) > {TARGET} THEN 1 ELSE 0 END FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
c AS (SELECT doc_id, chunk::BIGINT AS chunk, count(*) AS n_blocks, string_agg(line, chr(10) ORDER BY i) AS line FROM fold JOIN sized USING (doc_id, i) GROUP BY 1, 2),
packed AS (SELECT doc_id, chunk, n_blocks, greatest(1, ({_UNITS}) // 4)::BIGINT AS tokens FROM c)"""


@query("segments", r"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS ord, segment, n_tokens FROM (
 SELECT doc_id, i, trim(line) AS segment, len(regexp_extract_all(lower(line), '[\p{L}\p{N}]+')) AS n_tokens FROM
 (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE segment <> '' AND n_tokens >= 3""")
def segments(spark, sf_dir):
    return documents.segments(table(spark, sf_dir, "documents"), least=3)


@query("token_estimate", f"SELECT doc_id, greatest(1, (length(text) + 5 * len(regexp_extract_all(text, '{_WIDE}'))) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("chunk_pack", f"WITH RECURSIVE {_PACKED} SELECT * FROM packed")
def chunk_pack(spark, sf_dir):
    return documents.line_chunks(table(spark, sf_dir, "documents"), TARGET).select("doc_id", "chunk", "n_blocks", "tokens")


@query("chunk_size_distribution", f"WITH RECURSIVE {_PACKED} SELECT count(*) AS n, count_if(tokens < 100)::BIGINT AS n_small, count_if(tokens BETWEEN 100 AND 600)::BIGINT AS n_in_range, count_if(tokens > 600)::BIGINT AS n_large, min(tokens) AS least, max(tokens) AS most, round(avg(tokens), 6) AS average, median(tokens) AS median FROM packed")
def chunk_size_distribution(spark, sf_dir):
    return documents.size_distribution(documents.line_chunks(table(spark, sf_dir, "documents"), TARGET))


@query("coverage_eval", "WITH h AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1) SELECT item_id, doc_id, doc_id IS NOT NULL AS found FROM benchmark LEFT JOIN h USING (item_id)")
def coverage_eval(spark, sf_dir):
    return documents.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"), "doc_id")


@query("manifest_fingerprint", "SELECT 'documents/' || doc_id || '.md' AS path, upper(sha256('documents/' || doc_id || '.md' || chr(10) || chr(10) || text)) AS fingerprint FROM documents")
def manifest_fingerprint(spark, sf_dir):
    return ingest.manifest(_sources(spark, sf_dir))


@query("change_set", "SELECT 'documents/' || doc_id || '.md' AS path, CASE WHEN doc_id % 17 = 0 THEN 'removed' WHEN doc_id % 10 = 0 AND upper(text) <> text THEN 'changed' ELSE 'unchanged' END AS change FROM documents")
def change_set(spark, sf_dir):
    before = _sources(spark, sf_dir)
    after = before.where("doc_id % 17 <> 0").withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.upper("content")).otherwise(F.col("content")))
    return ingest.plan(ingest.manifest(before), after)


@query("fact_merge", r"""
WITH f AS (SELECT trim(string_split(text, chr(10))[1]) AS label, CASE WHEN lang = 'en' THEN 'schema:Thing' ELSE 'schema:Article' END AS type, n_chars AS confidence, source, doc_id AS ordinal FROM documents)
SELECT lower(trim(label)) AS key, arg_max(label, length(label) * 100000000 - ordinal) AS label, arg_max(type, CASE WHEN type = 'schema:Thing' THEN 0 ELSE 100000000 END - ordinal) AS type,
 max(confidence) AS confidence, arg_min(source, ordinal) AS source, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM f GROUP BY 1""")
def fact_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    facts = docs.select(F.trim(F.element_at(F.split("text", "\n"), 1)).alias("label"), F.when(F.col("lang") == "en", "schema:Thing").otherwise("schema:Article").alias("type"), F.col("n_chars").alias("confidence"), "source", F.col("doc_id").alias("ordinal"))
    return documents.merged_facts(facts).withColumn("sources", F.array_join("sources", ","))


@query("snippet_window", """
WITH a AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'ther') > 0 THEN instr(lower(text), 'ther') ELSE 1 END AS p FROM documents),
b AS (SELECT *, greatest(1, least(p - 60, length(text) - 119)) AS s FROM a)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, 120) || CASE WHEN s + 120 <= length(text) THEN '...' ELSE '' END END AS snippet FROM b""")
def snippet_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("ther"), 120).alias("snippet"))


@query("page_links", r"""SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


# -- exports

def _graph(spark, sf_dir):
    return triples.union(triples.star(spark, sf_dir), triples.corpus(spark, sf_dir))


_QUOTED = lambda c: f"""replace(replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"""
_SHORT = "CASE " + " ".join(f"WHEN starts_with(p, '{v}') THEN '{k}:' || substr(p, {len(v) + 1})" for k, v in sorted(PREFIXES.items(), key=lambda x: -len(x[1]))) + " ELSE p END"


@query("ntriples_lines", f"""
WITH {GRAPH} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN dt IS NULL THEN '<' || o || '>' ELSE '"' || {_QUOTED("o")} || '"' || CASE WHEN dt = 'string' THEN '' ELSE '^^<{triples.XSD}' || dt || '>' END END || ' .' AS value FROM g""")
def ntriples_lines(spark, sf_dir):
    return rdf.ntriples(_graph(spark, sf_dir))


@query("mermaid_edges", f"""WITH {GRAPH} SELECT '  n' || substr(sha256(s), 1, 12) || '["' || s || '"] -->|' || {_SHORT} || '| n' || substr(sha256(o), 1, 12) || '["' || o || '"]' AS value FROM g WHERE dt IS NULL""")
def mermaid_edges(spark, sf_dir):
    return rdf.mermaid(_graph(spark, sf_dir))


@query("dot_edges", f"""WITH {GRAPH} SELECT '  "' || s || '" -> "' || o || '" [label="' || {_SHORT} || '"];' AS value FROM g WHERE dt IS NULL""")
def dot_edges(spark, sf_dir):
    return rdf.dot(_graph(spark, sf_dir))


@query("edge_order", f"WITH {GRAPH} SELECT row_number() OVER (ORDER BY s, p, o) AS n, s, p, o FROM g WHERE dt IS NULL")
def edge_order(spark, sf_dir):
    return rdf.numbered_edges(_graph(spark, sf_dir))


@query("curies", f"SELECT DISTINCT '{PREFIXES['kb']}' || p_type AS type, 'kb:' || p_type AS short FROM part")
def curies(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").select(F.concat(F.lit(PREFIXES["kb"]), "p_type").alias("type")).distinct()
    return kinds.select("type", triples.curie(F.col("type")).alias("short"))


@query("slugs", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


# -- files


def _stored(spark, g, name: str):
    """A graph written to the shared folder and read again."""
    store = FolderStore(spark, f"{shared_folder(spark)}/graphloom-files-{uuid.uuid4().hex}", "gzip")
    store.save(name, g)
    return store.load(name)


@query("graph_file_round_trip", f"WITH {GRAPH} SELECT DISTINCT s, p, o, dt FROM g")
def graph_file_round_trip(spark, sf_dir):
    back = _stored(spark, _graph(spark, sf_dir), "whole.nt")
    kind = F.when(F.col("o_kind") == "literal", F.coalesce(F.replace("o_dt", F.lit(triples.XSD), F.lit("")), F.lit("string")))
    return back.select("s", "p", "o", kind.alias("dt")).distinct()  # lines of one order can repeat


@query("jsonld_round_trip", f"WITH {GRAPH} SELECT DISTINCT s, p, o, dt FROM g WHERE starts_with(s, '{BASE}part/') OR starts_with(s, '{BASE}order/') OR starts_with(s, '{BASE}line/') OR starts_with(s, '{BASE}region/') OR starts_with(s, '{BASE}nation/') OR starts_with(s, '{BASE}supplier/') OR starts_with(s, '{BASE}customer/')")
def jsonld_round_trip(spark, sf_dir):
    back = _stored(spark, triples.star(spark, sf_dir), "star.jsonl")
    return back.select("s", "p", "o", F.replace("o_dt", F.lit(triples.XSD), F.lit("")).alias("dt"))


@query("manifest_round_trip", "SELECT 'documents/' || doc_id || '.md' AS path, upper(sha256('documents/' || doc_id || '.md' || chr(10) || chr(10) || text)) AS fingerprint FROM documents")
def manifest_round_trip(spark, sf_dir):
    at = f"{shared_folder(spark)}/graphloom-manifest-{uuid.uuid4().hex}"
    save_manifest(ingest.manifest(_sources(spark, sf_dir)), at)
    return load_manifest(spark, at)
