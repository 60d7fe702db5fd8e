"""The facade: build a knowledge graph from documents, then query, search, validate, compare, infer, save and answer."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import build, documents, facts, shapes, terms, triples, vectors
from graphloom.operators import search as graph_search
from graphloom.operators import rules as rule_ops
from graphloom.operators.lineage import written
from graphloom.sources import files, rdf
from graphloom.sparql import Engine
from graphloom.streaming import ingest

MODES = ("graph", "bm25", "semantic", "hybrid")


def collected(df: DataFrame, seconds: float = 30.0) -> list[Row]:
    """The rows of a small result; its jobs are cancelled, and TimeoutError raised, when they take longer."""
    sc, tag, late = df.sparkSession.sparkContext, f"graphloom-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


@dataclass
class KnowledgeGraph:
    """A set of triples and what can be asked of it. Every method gives a lazy DataFrame unless it says otherwise."""

    triples: DataFrame

    def select(self, text: str, limit: int | None = 100) -> DataFrame:
        return Engine(self.triples).select(text, limit)

    def ask(self, text: str) -> bool:
        return Engine(self.triples).ask(text).first()["answer"]

    def federated(self, services: dict[str, KnowledgeGraph], allowed: set[str] | None = None) -> Engine:
        """An engine whose SERVICE addresses are other graphs; only allowed ones, by default those given."""
        return Engine(self.triples, {k: g.triples for k, g in services.items()}, allowed=set(services) if allowed is None else allowed)

    @staticmethod
    def services(*bindings: tuple[str, KnowledgeGraph]) -> dict[str, KnowledgeGraph]:
        """Graphs by address for ``federated``; an address that isn't absolute, or comes twice, raises ValueError."""
        out: dict[str, KnowledgeGraph] = {}
        for address, graph in bindings:
            if ":" not in address:
                raise ValueError(f"no absolute address: {address!r}")
            if address in out:
                raise ValueError(f"bound twice: {address}")
            out[address] = graph
        return out

    def merge(self, *others: KnowledgeGraph) -> KnowledgeGraph:
        return KnowledgeGraph(triples.merge(self.triples, *[o.triples for o in others]))

    def diff(self, later: KnowledgeGraph) -> dict[str, DataFrame]:
        return {"edges": triples.edge_diff(self.triples, later.triples), "nodes": triples.node_diff(self.triples, later.triples), "literals": triples.changed_literals(self.triples, later.triples)}

    def describe(self) -> dict[str, DataFrame]:
        return {"types": triples.type_census(self.triples), "predicates": triples.predicate_census(self.triples)}

    def infer(self, rdfs: bool = True, skos: bool = True, rules: Sequence[str] = ()) -> KnowledgeGraph:
        """A graph with what follows; this one stays as it is."""
        g = self.triples
        if rdfs:
            g = triples.merge(g, triples.rdfs(g))
        if skos:
            g = triples.merge(g, triples.skos(g))
        return KnowledgeGraph(rule_ops.apply(g, rules) if rules else g)

    def validate(self, wanted: Sequence[shapes.Shape] = tuple(shapes.DEFAULT)) -> DataFrame:
        return shapes.validate(self.triples, wanted)

    def search(self, query: str, mode: str = "graph", k: int = 10, index: SemanticIndex | None = None, fuzzy: int = 0, fusion: str = "canonical", candidates: DataFrame | None = None) -> DataFrame:
        """(node_id, score, ...) by canonical match, BM25, vectors or both."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if k <= 0:
            raise ValueError("k must be positive")
        if mode in ("semantic", "hybrid") and index is None:
            raise ValueError(f"{mode} search needs a semantic index")
        found = graph_search.candidates(self.triples)
        if candidates is not None:
            found = found.join(candidates.select("node_id").distinct(), "node_id", "left_semi")
        if mode == "bm25":
            return terms.bm25(found, query, k, id_col="node_id", fuzzy=fuzzy).withColumnRenamed("doc_id", "node_id")
        exact = graph_search.canonical(found, query, k)
        if mode == "graph":
            return exact
        near = index.search(query, k, among=found)
        if mode == "semantic":
            return near.join(found.select("node_id", "label"), "node_id").orderBy(F.desc("score"), "node_id")
        exact = exact.select("node_id", "score")
        return vectors.reciprocal_rank_fusion(exact, near, k) if fusion == "rrf" else vectors.canonical_first(exact, near, k)

    def search_by_schema(self, query: str, profile: graph_search.Profile = graph_search.Profile(), k: int = 10) -> dict[str, DataFrame]:
        primary = written(graph_search.schema_matches(self.triples, query, profile, k))  # used several times
        more = graph_search.expansion(self.triples, primary, profile)
        nodes, edges = graph_search.schema_subgraph(self.triples, primary.select("node_id").unionByName(more.select("node_id")), profile)
        return {"primary": primary.orderBy(F.desc("score"), F.lower(F.coalesce("label", "node_id")), "node_id"), "expansion": more, "nodes": nodes, "edges": edges}

    def search_federated(self, query: str, services: dict[str, KnowledgeGraph], profile: graph_search.Profile = graph_search.Profile(), k: int = 10, allowed: set[str] | None = None) -> DataFrame:
        """The schema search over other graphs by address, allowed ones only; evidence says where it is from."""
        refused = set(services) - (set(services) if allowed is None else allowed)
        if refused:
            raise PermissionError(f"not allowed: {sorted(refused)}")
        return graph_search.schema_matches({a: g.triples for a, g in services.items()}, query, profile, k)

    def __getitem__(self, node: str) -> dict[str, list[str]]:
        """The values of one node by prefixed predicate; its triples come to the driver."""
        out: dict[str, list[str]] = {}
        for r in self.triples.where(F.col("s") == triples.iri(node)).select(triples.curie(F.col("p")).alias("p"), "o").orderBy("p", "o").collect():
            out.setdefault(r["p"], []).append(r["o"])
        return out

    def search_focused(self, query: str, k: int = 3, related: int = 6, steps: int = 6, index: SemanticIndex | None = None, profile: graph_search.Profile | None = None, primary: DataFrame | None = None) -> dict[str, DataFrame]:
        """Primary matches, what relates to them, what comes next, and the part of the graph that holds all these.

        With a ``profile`` the primary matches are those of a schema search; ``primary`` (node_id, score) gives others,
        such as the nearest of a token index."""
        first = primary if primary is not None else graph_search.schema_search(self.triples, query, profile, max(1, k)) if profile else self.search(query, "hybrid" if index else "graph", max(1, k), index)
        primary = written(first.select("node_id", "score"))  # used four times
        near, following = graph_search.related(self.triples, primary, related), graph_search.next_steps(self.triples, primary, steps)
        every = primary.select("node_id").unionByName(near.select("node_id")).unionByName(following.select("node_id"))
        return {"primary": primary, "related": near, "next_steps": following, "graph": graph_search.subgraph(self.triples, every)}

    def semantic_index(self, embed: Callable[[DataFrame], DataFrame], embed_query: Callable[[str], Sequence[float]]) -> SemanticIndex:
        """``embed`` adds an ``embedding`` column to (node_id, text); ``embed_query`` gives a query's vector."""
        return SemanticIndex(embed(graph_search.candidates(self.triples).select("node_id", "text")), embed_query)

    def save(self, path: str, kind: str = "ntriples") -> None:
        rdf.write(self.triples, path, kind)

    def diagram(self, kind: str = "mermaid") -> str:
        return rdf.diagram({"mermaid": rdf.mermaid, "dot": rdf.dot}[kind](self.triples), kind)

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str | None = None) -> KnowledgeGraph:
        """A saved graph; without ``kind`` the path's extension tells the format."""
        return KnowledgeGraph(rdf.read(spark, path, kind))

    @staticmethod
    def load_directory(spark: SparkSession, path: str) -> KnowledgeGraph:
        return KnowledgeGraph(rdf.read_directory(spark, path))

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        return rdf.snapshot(self.triples)

    @staticmethod
    def from_snapshot(nodes: DataFrame, edges: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(rdf.from_snapshot(nodes, edges))


@dataclass
class SemanticIndex:
    vectors: DataFrame
    embed_query: Callable[[str], Sequence[float]]

    def search(self, query: str, k: int = 10, least: float = 0.4, among: DataFrame | None = None) -> DataFrame:
        """The nearest nodes; with ``among`` (node_id) of these only."""
        own = self.vectors if among is None else self.vectors.join(among.select("node_id").distinct(), "node_id", "left_semi")
        return vectors.semantic(own, self.embed_query(query), k, least, id_col="node_id")


@dataclass
class Build:
    """A graph with the sources it came from."""

    graph: KnowledgeGraph
    sources: DataFrame
    options: build.Options

    @property
    def manifest(self) -> DataFrame:
        return ingest.manifest(self.sources)

    @property
    def problems(self) -> DataFrame:
        return build.diagnostics(self.sources, self.options)

    def chunks(self, chunker: Callable[[str], list[dict]] = documents.chunks_of) -> DataFrame:
        return documents.chunks(self.sources, chunker, "path", "content")

    def evaluate_chunks(self, expected: DataFrame, chunker: Callable[[str], list[dict]] = documents.chunks_of) -> dict[str, DataFrame]:
        """Sizes and coverage of ``expected`` (item_id, text) by the chunks."""
        found = self.chunks(chunker)
        named = found.withColumn("chunk_id", F.concat_ws("#", "doc_id", "ord"))
        return {"sizes": documents.size_distribution(found), "coverage": documents.coverage(named.select("chunk_id", "text"), expected, id_col="chunk_id")}

    def token_distance(self, query: str, k: int = 3, fuzzy: int = 0) -> DataFrame:
        if fuzzy:
            query = terms.corrected(self.sources, query, edits=fuzzy, id_col="path", text_col="content")
        return terms.token_distance(self.sources, query, k, "path", "content")

    def nodes(self) -> DataFrame:
        """(doc_id, path): the node of every source."""
        return build.named(self.sources, self.options)

    def node_chunks(self, chunker: Callable[[str], list[dict]] = documents.chunks_of) -> DataFrame:
        """``chunks`` by the node of their document."""
        own = self.chunks(chunker).withColumnRenamed("doc_id", "source_path")
        return own.join(self.nodes().select(F.col("path").alias("source_path"), "doc_id"), "source_path")

    def search(self, query: str, k: int = 10, fuzzy: int = 0, scope: DataFrame | None = None) -> DataFrame:
        """(node_id, score) by BM25 over the graph's nodes, documents with the text of their chunks. ``scope``: (node_id)
        of the documents that may be used, with what is derived from them."""
        found = graph_search.document_candidates(graph_search.candidates(self.graph.triples), self.node_chunks())
        allowed = None if scope is None else graph_search.in_scope(self.graph.triples, scope)
        return terms.bm25(found, query, k, id_col="node_id", fuzzy=fuzzy, candidates=allowed).withColumnRenamed("doc_id", "node_id")

    def answer(self, question: str, model: Callable[[str], str], k: int = 5, rewrite: Callable[[str], str] | None = None, history: Sequence[tuple[str, str]] = (), scope: DataFrame | None = None) -> dict:
        """A model's answer from the best matching chunks, with numbered citations, one a document.

        ``history`` (role, text) goes to ``rewrite``, which makes a question that stands alone, and into the prompt.
        At most k rows reach the driver."""
        told = "\n".join(f"{role}: {text}" for role, text in history)
        asked = rewrite(f"{told}\nuser: {question}" if told else question) if rewrite else question
        matches = written(self.search(asked, 4 * k, scope=scope))
        found = graph_search.candidates(self.graph.triples).select("node_id", "label", "description")
        best = graph_search.best_chunks(matches.join(found, "node_id"), self.graph.triples, self.node_chunks(), asked)
        first = best.groupBy("document").agg(F.max_by(F.struct("score", "text"), F.struct("score", "anchor")).alias("b"))
        rows = first.select("document", "b.score", X.snippet(F.col("b.text"), F.lit(asked)).alias("snippet")).orderBy(F.desc("score"), "document").limit(k).join(self.nodes().select(F.col("doc_id").alias("document"), "path"), "document", "left")
        cited = [{"index": i, "document": r["path"] or r["document"], "score": r["score"], "snippet": r["snippet"]} for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["score"], r["document"])), 1)]
        prompt = "\n".join([*[f"[{c['index']}] {c['document']}: {c['snippet']}" for c in cited], *([told] if told else []), f"Question: {asked}"])
        return {"answer": model(prompt), "citations": cited}


class KnowledgeBank:
    def __init__(self, spark: SparkSession, options: build.Options = build.Options()) -> None:
        self.spark, self.options = spark, options

    def build(self, sources: DataFrame, tokens: bool = False, layers: bool = True, model: Callable[[str, str], object] | None = None, cache: str | None = None, made_by: Sequence[str] = ()) -> Build:
        """From (path, content[, canonical]) rows. The graph is written once to the shared folder.

        A ``model`` of (document, chunk) adds the facts it finds in the chunks; a ``cache`` folder keeps its answers."""
        parts = [build.graph(sources, self.options, tokens, layers)]
        if model is not None:
            chunks = Build(None, sources, self.options).node_chunks().select("doc_id", "ord", "text")
            answers = facts.cached(chunks, model, cache, *made_by) if cache else facts.extract(chunks, model)
            found = written(facts.parsed(answers.where("payload IS NOT NULL")))
            parts.append(facts.as_triples(*facts.merge(facts.entity_rows(found, self.options.base), facts.assertion_rows(found, self.options.base))))
        return Build(KnowledgeGraph(written(triples.merge(*parts))), sources, self.options)

    def build_from_markdown(self, content: str, path: str = "document.md", **options: bool) -> Build:
        return self.build(files.inline(self.spark, [(path, content)]), **options)

    def build_from_directory(self, path: str, glob: str | None = None, **options: bool) -> Build:
        return self.build(files.read(self.spark, path, glob), **options)

    build_from_file = build_from_directory

    def plan_changes(self, before: DataFrame | None, sources: DataFrame) -> DataFrame:
        return ingest.plan(before, sources)

    def build_incremental(self, before: Build | None, sources: DataFrame, **options: bool) -> tuple[Build, DataFrame, dict[str, DataFrame] | None]:
        """The new build, the change plan, and how the graph differs from the one before."""
        changes = self.plan_changes(before.manifest if before else None, sources)
        new = self.build(sources, **options)
        return new, changes, before.graph.diff(new.graph) if before else None

    def translate(self, question: str, model: Callable[[str], str]) -> str:
        """A question as a read-only query by a model; code fences are stripped, what doesn't parse raises."""
        from graphloom.sparql import parse

        text = model(question).strip().removeprefix("```sparql").removeprefix("```").removesuffix("```").strip()
        parse(text)
        return text
