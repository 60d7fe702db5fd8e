"""Term, vector and ranking queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import entities, terms, triples, vectors
from graphloom.plans.graph_sql import GRAPH
from graphloom.plans.registry import ORACLES, query, table, text_index

ASKED = "the theran inen stel"
MISSPELT = "therre inenn stelp erane"

_TOKENS = r"SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []::VARCHAR[]) AS toks FROM documents"
_TF = "tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1, 2)"


def _values(query_text: str) -> str:
    return ", ".join(f"('{t}')" for t in terms.terms_of(query_text))


def _bm25(narrowed: str = "") -> str:
    return f"""
WITH t AS ({_TOKENS}{narrowed}), {_TF}, q(term) AS (VALUES {_values(ASKED)}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT tf.doc_id, round(sum(ln(1 + (stats.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf.n * 2.2::DOUBLE / (tf.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / avgdl))), 6) AS score
      FROM tf JOIN df USING (term) JOIN t ON t.doc_id = tf.doc_id, stats GROUP BY 1)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10"""


@query("term_frequency", f"WITH t AS ({_TOKENS}), {_TF} SELECT doc_id, term, n FROM tf")
def term_frequency(spark, sf_dir):
    return terms.term_frequency(table(spark, sf_dir, "documents"))


@query("document_frequency", f"WITH t AS ({_TOKENS}) SELECT term, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1")
def document_frequency(spark, sf_dir):
    return terms.document_frequency(table(spark, sf_dir, "documents"))


@query("doc_length_stats", f"WITH t AS ({_TOKENS}) SELECT count(*) AS n_docs, sum(len(toks))::BIGINT AS n_tokens, avg(len(toks)) AS avg_tokens FROM t")
def doc_length_stats(spark, sf_dir):
    return terms.length_stats(table(spark, sf_dir, "documents"))


@query("bm25_topk", _bm25())
def bm25_topk(spark, sf_dir):
    return text_index(spark, sf_dir).bm25(ASKED)


@query("bm25_scoped", _bm25(" WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def bm25_scoped(spark, sf_dir):
    return terms.bm25(table(spark, sf_dir, "documents"), ASKED, candidates=table(spark, sf_dir, "labels").where("quality = 1"))


@query(
    "bm25_batch",
    rf"""
WITH t AS ({_TOKENS}), {_TF},
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1),
w AS (SELECT tf.doc_id, term, ln(1 + (stats.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf.n * 2.2::DOUBLE / (tf.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / avgdl)) AS w
      FROM tf JOIN df USING (term) JOIN t ON t.doc_id = tf.doc_id, stats),
s AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM w JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
)
def bm25_batch(spark, sf_dir):
    return text_index(spark, sf_dir).bm25_batch(table(spark, sf_dir, "benchmark"))


@query("bm25_fuzzy", f"""
WITH t AS ({_TOKENS}), {_TF}, q(term) AS (VALUES {_values(MISSPELT)}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t),
near AS (SELECT doc_id, q.term AS q, n, CASE WHEN tf.term = q.term THEN 0 ELSE levenshtein(tf.term, q.term) END AS d
         FROM tf JOIN q ON tf.term = q.term OR (length(q.term) >= 4 AND length(tf.term) >= 4 AND abs(length(tf.term) - length(q.term)) <= 1 AND regexp_full_match(tf.term, '[a-z0-9]+') AND levenshtein(tf.term, q.term) <= 1)),
best AS (SELECT doc_id, q, min(d) AS d FROM near GROUP BY 1, 2),
f AS (SELECT doc_id, q, sum(n * (1 - d / length(q)::DOUBLE)) AS tf FROM near JOIN best USING (doc_id, q, d) GROUP BY 1, 2),
df AS (SELECT q, count(*)::DOUBLE AS df FROM f GROUP BY 1),
s AS (SELECT doc_id, round(sum(ln(1 + (stats.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / avgdl))), 6) AS score
      FROM f JOIN df USING (q) JOIN t USING (doc_id), stats GROUP BY 1)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_fuzzy(spark, sf_dir):
    return text_index(spark, sf_dir).bm25(MISSPELT, fuzzy=1)


_VOCABULARY = f"WITH t AS ({_TOKENS}), v AS (SELECT term, count(*) AS frequency FROM (SELECT unnest(toks) AS term FROM t) WHERE regexp_full_match(term, '[a-z0-9]+') GROUP BY 1), q(query_term) AS (VALUES {_values(MISSPELT)})"


# the SQL function counts bytes; the asked terms are ASCII, so any other character of a term can be one byte that none of them has
@query("full_text", f"""
WITH {GRAPH}, t AS (SELECT s AS doc_id, coalesce(regexp_extract_all(lower(array_to_string(list_distinct(list(o)), chr(10))), '[\\p{{L}}\\p{{N}}]+'), []::VARCHAR[]) AS toks FROM g WHERE dt IS NOT NULL GROUP BY s), {_bm25().split("FROM documents), ", 1)[1]}""".replace("SELECT doc_id, score FROM s", "SELECT doc_id AS node_id, score FROM s").replace("ORDER BY score DESC, doc_id", "ORDER BY score DESC, doc_id"))
def full_text(spark, sf_dir):
    return entities.full_text(triples.union(triples.star(spark, sf_dir), triples.corpus(spark, sf_dir)), ASKED)


@query("edit_distance_join", f"""
WITH t AS ({_TOKENS}), v AS (SELECT DISTINCT unnest(toks) AS term FROM t), q(query_term) AS (VALUES {_values(MISSPELT)}),
c AS (SELECT query_term, term, levenshtein(regexp_replace(term, '[^a-z0-9]', '_', 'g'), query_term) AS distance FROM v, q WHERE length(term) >= 4 AND length(query_term) >= 4 AND abs(length(term) - length(query_term)) <= 2)
SELECT * FROM c WHERE distance <= 2""")
def edit_distance_join(spark, sf_dir):
    vocabulary = terms.document_frequency(table(spark, sf_dir, "documents"))
    return terms.within_edits(vocabulary, terms.terms_of(MISSPELT), 2).select("query_term", "term", "distance")


@query("fuzzy_corrections", f"""{_VOCABULARY},
n AS (SELECT *, levenshtein(term, query_term) AS d FROM v, q WHERE length(term) >= 4 AND length(query_term) >= 4 AND abs(length(term) - length(query_term)) <= 1 AND levenshtein(term, query_term) <= 1),
s AS (SELECT query_term, term, round(1 - d / greatest(length(term), length(query_term))::DOUBLE, 6) AS similarity, frequency FROM n WHERE query_term NOT IN (SELECT query_term FROM n WHERE d = 0))
SELECT *, row_number() OVER (PARTITION BY query_term ORDER BY similarity DESC, frequency DESC, term) AS rank FROM s QUALIFY rank <= 3""")
def fuzzy_corrections(spark, sf_dir):
    return text_index(spark, sf_dir).corrections(MISSPELT, best=3)


_WEIGHTS = f"""WITH t AS ({_TOKENS}), {_TF}, n AS (SELECT count(*) AS n_all FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf.n * (ln((n_all + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term), n)"""


@query("tfidf_weights", f"{_WEIGHTS} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
def tfidf_weights(spark, sf_dir):
    return terms.weights(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


@query("token_weights", f"WITH t AS ({_TOKENS}), {_TF} SELECT doc_id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS tf, round(1 / sqrt(count(*) OVER (PARTITION BY doc_id)), 6) AS present FROM tf")
def token_weights(spark, sf_dir):
    return terms.own_weights(table(spark, sf_dir, "documents")).select("doc_id", "term", F.round("tf", 6).alias("tf"), F.round("binary", 6).alias("present"))


@query("token_distance_topk", f"""{_WEIGHTS}, q(term, c) AS (VALUES {", ".join(f"('{t}', 1)" for t in ASKED.split())}),
qw AS (SELECT term, c * (ln((n_all + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS qw FROM q LEFT JOIN df USING (term), n),
s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, sum(w * coalesce(qw, 0)) AS dot FROM w LEFT JOIN qw USING (term) GROUP BY 1)
SELECT doc_id, round(CASE WHEN norm IS NULL THEN 1 ELSE sqrt(greatest(0, 2 - 2 * dot / norm / (SELECT sqrt(sum(qw * qw)) FROM qw))) END, 6) AS distance
FROM t LEFT JOIN s USING (doc_id) ORDER BY distance, doc_id LIMIT 3""")
def token_distance_topk(spark, sf_dir):
    return text_index(spark, sf_dir).token_distance(ASKED)


@query("related_segments", r"""
WITH t AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1, 2), n AS (SELECT count(*) AS n_all FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf.n * (ln((n_all + 1) / (df + 1)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term), n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
d AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS dot FROM u a JOIN u b USING (term) GROUP BY 1, 2),
every AS (SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT DISTINCT doc_id FROM u) a, (SELECT DISTINCT doc_id FROM u) b WHERE a.doc_id <> b.doc_id),
s AS (SELECT a, b, round(sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))), 6) AS distance FROM every LEFT JOIN d USING (a, b))
SELECT a AS doc_id, b AS related_id, distance, round(greatest(0, 1 - distance / sqrt(2)), 6) AS confidence, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM s QUALIFY rank <= 3""")
def related_segments(spark, sf_dir):
    return terms.related(table(spark, sf_dir, "benchmark"), id_col="item_id")


@query("related_documents", ORACLES["related_segments"].replace("item_id AS doc_id", "doc_id").replace("FROM benchmark", "FROM documents").replace("FROM u a JOIN u b USING (term)", "FROM u a JOIN u b USING (term) WHERE a.doc_id % 100 = 0").replace("WHERE a.doc_id <> b.doc_id", "WHERE a.doc_id <> b.doc_id AND a.doc_id % 100 = 0"))
def related_documents(spark, sf_dir):
    # every hundredth text is a query against all
    docs = table(spark, sf_dir, "documents")
    return terms.related(docs, asked=docs.where("doc_id % 100 = 0"))


@query("keyphrases_topk", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{M}\p{Nd}]+(?:[-''][\p{L}\p{M}\p{Nd}]+)*') AS w FROM documents),
r AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
c AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS n FROM r WHERE len(list_filter(w[i : i + k - 1], lambda x: length(x) >= 3)) > 0 GROUP BY 1, 2, 3),
df AS (SELECT phrase, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT doc_id, phrase, n, k, round(n * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) + 1) * sqrt(k::DOUBLE) * ln(length(phrase) + 1.0::DOUBLE), 6) AS score FROM c JOIN df USING (phrase))
SELECT doc_id, phrase, n, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k DESC, phrase) AS rank FROM s QUALIFY rank <= 8""")
def keyphrases_topk(spark, sf_dir):
    return terms.keyphrases(table(spark, sf_dir, "documents"))


# -- vectors

_FIRST = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
_SEMANTIC = f"SELECT vec_id AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], {_FIRST}), 6) AS score FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], {_FIRST}), 6) >= 0.1 ORDER BY score DESC, node_id LIMIT 10"
WANTED = "the"
_LABEL = r"trim(string_split(text, chr(10))[1])"
_CANONICAL = f"SELECT doc_id AS node_id, CASE WHEN lower({_LABEL}) = '{WANTED}' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS score FROM documents WHERE contains(lower({_LABEL}), '{WANTED}') ORDER BY score DESC, upper({_LABEL}), node_id LIMIT 10"


def _semantic(spark, sf_dir):
    vectors_table = table(spark, sf_dir, "embeddings")
    first = vectors_table.orderBy("vec_id").select("embedding").first()  # the query vector
    return vectors.semantic(vectors_table, first["embedding"] if first else [0.0], least=0.1)


def _canonical(spark, sf_dir):
    from graphloom.operators import search

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.trim(F.element_at(F.split("text", "\n"), 1)).alias("label"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("related"))
    return search.canonical(docs, WANTED).select("node_id", "score")


@query("semantic_topk", _SEMANTIC)
def semantic_topk(spark, sf_dir):
    return _semantic(spark, sf_dir)


@query("canonical_search", _CANONICAL)
def canonical_search(spark, sf_dir):
    return _canonical(spark, sf_dir)


_LISTS = f"""WITH a AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS ra FROM ({_CANONICAL})),
b AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rb FROM ({_SEMANTIC})),
f AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, ra, rb, a.score AS sa, b.score AS sb, CASE WHEN ra IS NULL THEN 'Semantic' WHEN rb IS NULL THEN 'Canonical' ELSE 'Merged' END AS source FROM a FULL JOIN b ON a.node_id = b.node_id)"""


@query("hybrid_rrf", f"{_LISTS} SELECT node_id, source, round(coalesce(1 / (60 + ra)::DOUBLE, 0) + coalesce(1 / (60 + rb)::DOUBLE, 0), 6) AS score FROM f ORDER BY score DESC, node_id LIMIT 10")
def hybrid_rrf(spark, sf_dir):
    return vectors.reciprocal_rank_fusion(_canonical(spark, sf_dir), _semantic(spark, sf_dir))


@query("hybrid_canonical_first", f"{_LISTS} SELECT node_id, source, round(coalesce(sa, 0) + coalesce(sb, 0), 6) AS score, row_number() OVER (ORDER BY ra IS NULL, coalesce(ra, rb)) AS place FROM f QUALIFY place <= 10")
def hybrid_canonical_first(spark, sf_dir):
    return vectors.canonical_first(_canonical(spark, sf_dir), _semantic(spark, sf_dir))
