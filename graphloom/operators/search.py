"""Search over a graph: candidates, canonical ranking, evidence by a schema profile, focused expansion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .terms import terms_of
from .triples import TYPE, iri, union


@dataclass(frozen=True)
class Profile:
    """What a schema search reads: weights of text predicates, relationships and expansions, and its filters."""

    text: dict[str, float] = field(default_factory=lambda: {"schema:name": 1.0, "rdfs:label": 1.0, "skos:prefLabel": 1.0, "skos:altLabel": 1.0, "schema:description": 0.8, "schema:keywords": 0.8})
    relations: dict[str, float] = field(default_factory=lambda: {"schema:about": 0.7, "schema:mentions": 0.7, "kb:memberOf": 0.7})
    labels: tuple[str, ...] = ("schema:name", "skos:prefLabel", "rdfs:label")
    expansions: dict[str, float] = field(default_factory=lambda: {"kb:relatedTo": 0.8, "kb:nextStep": 0.8, "kb:memberOf": 0.75, "schema:isPartOf": 0.75})
    types: tuple[str, ...] = ()
    excluded_types: tuple[str, ...] = ("kb:MarkdownDocument", "kb:KnowledgeAssertion")
    facets: tuple[tuple[str, str], ...] = ()
    mode: str = "phrase"  # phrase, all or any
    inbound: bool = False

    def problems(self, g: DataFrame) -> DataFrame:
        """(kind, name) of predicates and types of the profile that the graph lacks."""
        spark = g.sparkSession
        wanted = [("predicate", iri(p)) for p in [*self.text, *self.relations, *self.labels, *self.expansions, *[p for p, _ in self.facets]]] + [("type", iri(t)) for t in self.types]
        asked = spark.createDataFrame(list(dict.fromkeys(wanted)), "kind string, name string")
        have = g.select(F.lit("predicate").alias("kind"), F.col("p").alias("name")).unionByName(g.where(F.col("p") == TYPE).select(F.lit("type").alias("kind"), F.col("o").alias("name"))).distinct()
        return asked.join(have, ["kind", "name"], "left_anti")


def candidates(g: DataFrame) -> DataFrame:
    """(node_id, label, description, related, text) of typed nodes that have any of these."""
    p = F.col("p")
    own = g.where(p.isin(TYPE, iri("schema:name"), iri("schema:description")) & (F.col("s_kind") == "iri")).groupBy(F.col("s").alias("node_id")).agg(
        F.max(p == TYPE).alias("typed"), F.min(F.when(p == iri("schema:name"), F.col("o"))).alias("label"), F.min(F.when(p == iri("schema:description"), F.col("o"))).alias("description")
    )
    names = g.where(p == iri("schema:name")).groupBy(F.col("s").alias("x")).agg(F.min("o").alias("name"))
    links = g.where(p.isin(iri("schema:mentions"), iri("schema:about")) & (F.col("o_kind") == "iri")).select(F.col("s").alias("node_id"), F.col("o").alias("x"))
    gathered = links.join(names, "x").groupBy("node_id", F.lower("name")).agg(F.min("name").alias("name")).groupBy("node_id").agg(F.array_sort(F.collect_list("name")).alias("related"))
    joined = own.where("typed").drop("typed").join(gathered, "node_id", "left").where("label IS NOT NULL OR description IS NOT NULL OR related IS NOT NULL")
    text = F.concat_ws("\n", F.trim("label"), F.trim("description"), F.array_join("related", "\n"))
    return joined.select("node_id", "label", "description", F.coalesce("related", F.array().cast("array<string>")).alias("related"), text.alias("text"))


def canonical(found: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """(node_id, label, score): whole-query matches in label (1, 0.95), description (1, 0.75) and related labels (0.65)."""
    q = F.lit(query.strip().lower())
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    label = F.when(low("label") == q, 1.0).when(F.contains(low("label"), q), 0.95).otherwise(0.0)
    description = F.when(low("description") == q, 1.0).when(F.contains(low("description"), q), 0.75).otherwise(0.0)
    related = F.when(F.exists("related", lambda r: F.contains(F.lower(r), q)), 0.65).otherwise(0.0)
    scored = found.select("node_id", "label", F.greatest(label, description, related).alias("score")).where("score > 0")
    scored = scored.orderBy(F.desc("score"), F.upper("label"), "node_id")
    return scored if k is None else scored.limit(k)


def _matches(text: Column, query: str, mode: str) -> Column:
    low, q = F.lower(text), query.strip().lower()
    if mode == "phrase":
        return F.contains(low, F.lit(q))
    parts = [F.contains(low, F.lit(t)) for t in terms_of(query)] or [F.lit(False)]
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), parts)


def _weight(p: Column, weights: dict[str, float]) -> Column:
    return reduce(lambda c, x: c.when(p == iri(x[0]), x[1]), list(weights.items())[1:], F.when(p == iri(next(iter(weights))), next(iter(weights.values())))).otherwise(0.0)


def document_candidates(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``candidates`` with the headings and texts of a node's own chunks (doc_id, ord, path, text) added to its text."""
    own = chunks.select("doc_id", "ord", F.concat_ws("\n", F.array_join("path", "\n"), "text").alias("t"))
    own = own.groupBy(F.col("doc_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("more"))
    return found.join(own, "node_id", "left").withColumn("text", F.concat_ws("\n", "text", "more")).drop("more")


def in_scope(g: DataFrame, documents: DataFrame) -> DataFrame:
    """(node_id): the documents (node_id) and all nodes that are derived from them."""
    derived = g.where(F.col("p") == iri("prov:wasDerivedFrom")).join(documents.select("node_id").distinct(), F.col("o") == F.col("node_id"), "left_semi")
    return documents.select("node_id").unionByName(derived.select(F.col("s").alias("node_id"))).distinct()


def anchor_score(text: Column, query: str, label: Column, description: Column) -> Column:
    """How well a text shows a match: 1000 times the kind of the best anchor in it (the query 4, a word of it 3, the label
    2, the description 1), and the anchor's length; 0 without any. Anchors have three characters at least."""
    low = F.lower(F.coalesce(text, F.lit("")))
    given = [(F.lit(query.strip()), 4), *[(F.lit(w), 3) for w in dict.fromkeys(re.split(r"[\s,.;:!?()\[\]{}\"']+", query)) if w], (F.trim(label), 2), (F.trim(description), 1)]
    scores = [F.when((F.length(a) >= 3) & F.contains(low, F.lower(a)), p * 1000 + F.length(a)).otherwise(0) for a, p in given]
    return F.greatest(*scores, F.lit(0))


def context_overlap(text: Column, context: Column, least: int = 2, length: int = 5) -> Column:
    """Whether two texts share so many distinct words of so many characters."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\s,.;:!?()\[\]{}\"']+"), lambda w: F.length(w) >= length))
    return F.size(F.array_intersect(words(text), words(context))) >= least


def best_chunks(matches: DataFrame, g: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """(node_id, score, document, ord, text, anchor): for each match (node_id, label, description, score) the best chunk
    (doc_id, ord, text) of its own document, else of those it is derived from."""
    m = matches.select("node_id", "score", *[F.col(c) if c in matches.columns else F.lit(None).cast("string").alias(c) for c in ("label", "description")])
    own = m.join(chunks.select(F.col("doc_id").alias("document"), "ord", "text"), F.col("node_id") == F.col("document"))
    source = g.where(F.col("p") == iri("prov:wasDerivedFrom")).select(F.col("s").alias("node_id"), F.col("o").alias("document"))
    others = m.join(own.select("node_id").distinct(), "node_id", "left_anti").join(source, "node_id").join(chunks.select(F.col("doc_id").alias("document"), "ord", "text"), "document")
    both = own.unionByName(others.select(own.columns)).withColumn("anchor", anchor_score(F.col("text"), query, F.col("label"), F.col("description")))
    # of two equally good ones the first of the first document
    best = both.groupBy("node_id").agg(F.min_by(F.struct("score", "document", "ord", "text", "anchor"), F.struct(-F.col("anchor"), F.col("document"), F.col("ord"))).alias("b"))
    return best.select("node_id", "b.*")


def evidence(g: DataFrame, query: str, profile: Profile = Profile()) -> DataFrame:
    """(node_id, predicate, matched_text, kind, via, score): distinct literals that match, on the node or one relation away."""
    exact = F.when(F.lower("o") == query.strip().lower(), 1.0).otherwise(0.8)
    literal = g.where((F.col("o_kind") == "literal") & _matches(F.col("o"), query, profile.mode))
    own = literal.where(F.col("p").isin([iri(p) for p in profile.text]))
    direct = own.select(F.col("s").alias("node_id"), F.col("p").alias("predicate"), F.col("o").alias("matched_text"), F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("via"), (_weight(F.col("p"), profile.text) * exact).alias("score"))
    parts = [direct]
    if profile.relations:
        labels = literal.where(F.col("p").isin([iri(p) for p in profile.labels])).select(F.col("s").alias("via"), F.col("p").alias("label_p"), "o")
        ends = ("o", "s") if not profile.inbound else ("s", "o")
        edges = g.where(F.col("p").isin([iri(p) for p in profile.relations]) & (F.col("o_kind") == "iri")).select(F.col(ends[1]).alias("node_id"), F.col("p").alias("predicate"), F.col(ends[0]).alias("via"))
        parts.append(edges.join(labels, "via").select("node_id", "predicate", F.col("o").alias("matched_text"), F.lit("related").alias("kind"), "via", (_weight(F.col("predicate"), profile.relations) * exact).alias("score")))
    return union(*parts).distinct()


def _passing(found: DataFrame, g: DataFrame, profile: Profile) -> DataFrame:
    """Rows of nodes that pass the profile's type and facet filters."""
    typed = lambda ts: g.where((F.col("p") == TYPE) & F.col("o").isin([iri(t) for t in ts])).select(F.col("s").alias("node_id"))
    if profile.types:
        found = found.join(typed(profile.types), "node_id", "left_semi")
    if profile.excluded_types:
        found = found.join(typed(profile.excluded_types), "node_id", "left_anti")
    for p, o in profile.facets:
        found = found.join(g.where((F.col("p") == iri(p)) & (F.col("o") == o)).select(F.col("s").alias("node_id")), "node_id", "left_semi")
    return found


def schema_search(g: DataFrame, query: str, profile: Profile = Profile(), k: int | None = 10) -> DataFrame:
    """(node_id, score, n_evidence): the sum of distinct evidence of nodes that pass the type and facet filters."""
    found = evidence(g, query, profile).groupBy("node_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n_evidence"))
    ordered = _passing(found, g, profile).orderBy(F.desc("score"), "node_id")
    return ordered if k is None else ordered.limit(k)


def labels_of(g: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(node_id, label): the least label of the first of the profile's label predicates that a node has."""
    rank = reduce(lambda c, x: c.when(F.col("p") == iri(x[1]), x[0]), list(enumerate(profile.labels))[1:], F.when(F.col("p") == iri(profile.labels[0]), 0))
    return g.where(F.col("p").isin([iri(p) for p in profile.labels]) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("node_id")).agg(F.min_by("o", F.struct(rank, F.col("o"))).alias("label"))


_EVIDENCE = ("predicate", "matched_text", "kind", "via", "endpoint")


def schema_matches(graphs: DataFrame | dict[str, DataFrame], query: str, profile: Profile = Profile(), k: int = 10) -> DataFrame:
    """(node_id, label, description, types, score, evidence) of the k best matches: by score, then label letter case aside.

    Evidence that is the same but for the source it was found in counts once; it carries those sources (``contexts``:
    documents that the node, or the one it is related by, is derived from), sorted, and is ordered by score. ``graphs``
    may be several by the address of their endpoint: then each is asked, and evidence of each counts."""
    parts = graphs if isinstance(graphs, dict) else {None: graphs}
    found, every = [], []
    for endpoint, g in parts.items():
        own = _passing(evidence(g, query, profile), g, profile)
        source = g.where(F.col("p") == iri("prov:wasDerivedFrom")).select(F.col("s").alias("at"), F.col("o").alias("context")).distinct()
        own = own.withColumn("endpoint", F.lit(endpoint).cast("string")).withColumn("at", F.explode(F.array_distinct(F.array("node_id", F.coalesce("via", "node_id")))))
        found.append(own.join(source, "at", "left").drop("at"))
        every.append(g.where(F.col("o_kind") == "literal").where(F.col("p").isin([iri(p) for p in (*profile.labels, "schema:description")])))
        every.append(g.where(F.col("p") == TYPE))
    once = union(*found).groupBy("node_id", *_EVIDENCE).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("context")).alias("contexts"))
    whole = union(*every)
    total = once.groupBy("node_id").agg(F.round(F.sum("score"), 6).alias("score")).join(labels_of(whole, profile), "node_id", "left")
    best = total.orderBy(F.desc("score"), F.lower(F.coalesce("label", "node_id")), "node_id").limit(k)
    # only the k best get their lists
    lists = once.join(F.broadcast(best.select("node_id")), "node_id").groupBy("node_id").agg(F.collect_list(F.struct((-F.col("score")).alias("by"), *[F.coalesce(c, F.lit("")).alias(c) for c in _EVIDENCE], "score", "contexts")).alias("e"))
    types = whole.where(F.col("p") == TYPE).groupBy(F.col("s").alias("node_id")).agg(F.array_sort(F.collect_set("o")).alias("types"))
    told = whole.where(F.col("p") == iri("schema:description")).groupBy(F.col("s").alias("node_id")).agg(F.min("o").alias("description"))
    plain = F.transform(F.array_sort("e"), lambda x: F.struct(*[F.nullif(x[c], F.lit("")).alias(c) for c in _EVIDENCE], x["score"].alias("score"), x["contexts"].alias("contexts")))
    out = best.join(lists, "node_id").join(types, "node_id", "left").join(told, "node_id", "left")
    return out.select("node_id", "label", "description", F.coalesce("types", F.array().cast("array<string>")).alias("types"), "score", plain.alias("evidence")).orderBy(F.desc("score"), F.lower(F.coalesce("label", "node_id")), "node_id")


def schema_subgraph(g: DataFrame, selected: DataFrame, profile: Profile = Profile()) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label) that were selected, and edges (s, p, o) between them by the profile's predicates."""
    ids = selected.select("node_id").distinct()
    names = [iri(p) for p in {**profile.relations, **profile.expansions}]
    edges = g.where(F.col("p").isin(names) & (F.col("o_kind") == "iri")).join(ids, F.col("s") == F.col("node_id"), "left_semi").join(ids, F.col("o") == F.col("node_id"), "left_semi")
    return ids.join(labels_of(g, profile), "node_id", "left"), edges.select("s", "p", "o").distinct()


def escaped(text: str) -> str:
    """A string for a literal of a query: quotes and backslashes escaped, line breaks as spaces."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\r", " ").replace("\n", " ")


def explain(query: str, profile: Profile = Profile()) -> str:
    """A schema search as query text: literals of the node itself, and labels of what it is related to."""
    words = [query.strip()] if profile.mode == "phrase" else terms_of(query)
    tests = (" && " if profile.mode != "any" else " || ").join(f'CONTAINS(LCASE(STR(?text)), "{escaped(w.lower())}")' for w in words) or "false"
    types = f"  ?node a ?type . VALUES ?type {{ {' '.join(profile.types)} }}\n" if profile.types else ""
    without = "".join(f"  FILTER NOT EXISTS {{ ?node a {t} }}\n" for t in profile.excluded_types)
    facets = "".join(f'  ?node {p} "{escaped(o)}" .\n' for p, o in profile.facets)
    branches = [f"  {{ VALUES ?p {{ {' '.join(profile.text)} }} ?node ?p ?text . BIND(\"direct\" AS ?kind) FILTER(isLiteral(?text) && ({tests})) }}"]
    if profile.relations:
        edge = "?via ?p ?node" if profile.inbound else "?node ?p ?via"
        branches.append(f"  {{ VALUES ?p {{ {' '.join(profile.relations)} }} VALUES ?label {{ {' '.join(profile.labels)} }} {edge} . ?via ?label ?text . BIND(\"related\" AS ?kind) FILTER(isLiteral(?text) && ({tests})) }}")
    return f"SELECT DISTINCT ?node ?p ?text ?kind ?via WHERE {{\n{types}{without}{facets}" + " UNION\n".join(branches) + "\n}"


def expansion(g: DataFrame, primaries: DataFrame, profile: Profile = Profile(), k: int | None = None) -> DataFrame:
    """(node_id, predicate, score): the best edge from a primary to each other node."""
    edges = g.where(F.col("p").isin([iri(p) for p in profile.expansions]) & (F.col("o_kind") == "iri"))
    firsts = primaries.select("node_id").distinct()
    out = edges.join(firsts, F.col("s") == F.col("node_id"), "left_semi").select(F.col("o").alias("node_id"), F.col("p").alias("predicate"), _weight(F.col("p"), profile.expansions).alias("score"))
    best = out.join(firsts, "node_id", "left_anti").groupBy("node_id").agg(F.max_by("predicate", F.struct("score", "predicate")).alias("predicate"), F.max("score").alias("score"))
    ordered = best.orderBy(F.desc("score"), "node_id")
    return ordered if k is None else ordered.limit(k)


def related(g: DataFrame, primaries: DataFrame, k: int | None = 6) -> DataFrame:
    """(node_id, score, reason): direct relatedTo targets at 0.9, then articles of the same group at 0.7; best per node."""
    firsts = primaries.select("node_id").distinct()
    direct = g.where(F.col("p") == iri("kb:relatedTo")).join(firsts, F.col("s") == F.col("node_id"), "left_semi").select(F.col("o").alias("node_id"), F.lit(0.9).alias("score"), F.lit("relatedTo").alias("reason"))
    member = g.where(F.col("p") == iri("kb:memberOf")).select("s", F.col("o").alias("grp"))
    groups = member.join(firsts, F.col("s") == F.col("node_id"), "left_semi").select("grp").distinct()
    articles = g.where((F.col("p") == TYPE) & (F.col("o") == iri("schema:Article"))).select("s")
    peers = member.join(groups, "grp", "left_semi").join(articles, "s", "left_semi").select(F.col("s").alias("node_id")).distinct()
    peers = peers.join(firsts, "node_id", "left_anti").select("node_id", F.lit(0.7).alias("score"), F.lit("memberOf").alias("reason"))
    best = direct.unionByName(peers).groupBy("node_id").agg(F.max("score").alias("score"), F.max_by("reason", "score").alias("reason"))
    ordered = best.orderBy(F.desc("score"), "node_id")
    return ordered if k is None else ordered.limit(k)


def next_steps(g: DataFrame, primaries: DataFrame, k: int | None = 6) -> DataFrame:
    """(node_id, score): nextStep targets at 0.8."""
    steps = g.where(F.col("p") == iri("kb:nextStep")).join(primaries.select("node_id").distinct(), F.col("s") == F.col("node_id"), "left_semi").select(F.col("o").alias("node_id"), F.lit(0.8).alias("score")).distinct().orderBy("node_id")
    return steps if k is None else steps.limit(k)


def subgraph(g: DataFrame, selected: DataFrame) -> DataFrame:
    """Triples between selected nodes, their literals, and their membership edges."""
    ids = selected.select(F.col("node_id")).distinct()
    mine = g.join(ids, F.col("s") == F.col("node_id"), "left_semi")
    inner = mine.where("o_kind <> 'literal'").join(ids, F.col("o") == F.col("node_id"), "left_semi")
    return union(mine.where("o_kind = 'literal'"), inner, mine.where(F.col("p") == iri("kb:memberOf")).join(ids, F.col("o") == F.col("node_id"), "left_anti"))


def citations(matches: DataFrame, g: DataFrame, k: int | None = None) -> DataFrame:
    """(node_id, document, score, index): one citation a source document, best first, numbered from 1."""
    source = g.where(F.col("p") == iri("prov:wasDerivedFrom")).select(F.col("s").alias("node_id"), F.col("o").alias("document"))
    found = matches.join(source, "node_id")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("score"), "node_id"))).where("r = 1").drop("r")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "document")).cast("bigint")  # matches are a top-k already
    out = best.select("node_id", "document", "score").withColumn("index", place)
    return out if k is None else out.where(F.col("index") <= k)
