"""Fixed searches over a graph by label: terms, entities, articles, articles by entity; and full text over literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import terms
from graphloom.operators.triples import TYPE, iri


def _typed(g: DataFrame) -> DataFrame:
    return g.where(F.col("p") == TYPE).select("s", F.col("o").alias("type"))


def _named(g: DataFrame) -> DataFrame:
    return g.where((F.col("p") == iri("schema:name")) & (F.col("o_kind") == "literal")).select("s", F.col("o").alias("name"))


def by_name(g: DataFrame, term: str, excluded: tuple[str, ...] = (), k: int | None = 100) -> DataFrame:
    """(node_id, name, types): typed nodes whose name contains a term, letter case aside, by name."""
    hits = _named(g).where(F.contains(F.lower("name"), F.lit(term.strip().lower())))
    typed = _typed(g).where(~F.col("type").isin([iri(t) for t in excluded])) if excluded else _typed(g)
    rows = hits.join(typed, "s").groupBy("s").agg(F.min("name").alias("name"), F.array_join(F.array_sort(F.collect_set("type")), " ").alias("types"))
    ordered = rows.select(F.col("s").alias("node_id"), "name", "types").orderBy(F.upper("name"), "node_id")
    return ordered if k is None else ordered.limit(k)


def entities(g: DataFrame, term: str, k: int | None = 25) -> DataFrame:
    """Named nodes that aren't articles."""
    return by_name(g, term, ("schema:Article", "kb:MarkdownDocument"), k)


def articles(g: DataFrame, term: str, k: int | None = 25) -> DataFrame:
    """Articles by title."""
    own = g.join(_typed(g).where(F.col("type") == iri("schema:Article")).select("s").distinct(), "s", "left_semi")
    return by_name(own, term, (), k)


def articles_by_entity(g: DataFrame, label: str, k: int | None = 25) -> DataFrame:
    """(node_id, name) of articles that mention, or are about, a node whose name equals the label, letter case aside."""
    wanted = _named(g).where(F.lower("name") == label.strip().lower()).select(F.col("s").alias("x")).distinct()
    links = g.where(F.col("p").isin(iri("schema:mentions"), iri("schema:about"))).join(wanted, F.col("o") == F.col("x"), "left_semi").select("s").distinct()
    own = links.join(_typed(g).where(F.col("type") == iri("schema:Article")).select("s"), "s", "left_semi")
    rows = own.join(_named(g), "s").groupBy(F.col("s").alias("node_id")).agg(F.min("name").alias("name")).orderBy(F.upper("name"), "node_id")
    return rows if k is None else rows.limit(k)


def full_text(g: DataFrame, query: str, by: str = "s", k: int | None = 10) -> DataFrame:
    """(node_id, score): BM25 over literals gathered by subject (``s``) or by predicate (``p``), or each of its own (``o``)."""
    if by not in ("s", "p", "o"):
        raise ValueError("by must be s, p or o")
    texts = g.where("o_kind = 'literal'").groupBy(F.col(by).alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("o")), "\n").alias("text"))
    return terms.bm25(texts, query, k, id_col="node_id").withColumnRenamed("doc_id", "node_id")
