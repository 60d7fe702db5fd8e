"""Documents to triples: front matter, hints, authored rules, ontology and concept layers.

A document's triples depend on it alone, so they come out of one narrow Arrow-batched map; the layers on top are unions
and joins, and one set-wise deduplication ends the build.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.rows import flat_map
from graphloom.functions.text import slug_of
from graphloom.operators import documents, terms
from graphloom.operators.lineage import written
from graphloom.operators.search import Profile
from graphloom.operators.triples import BASE, COLUMNS, PREFIXES, SCHEMA, TYPE, XSD, branch, iri, merge, of_rows, union

ALIASES = {"mentions": "schema:mentions", "about": "schema:about", "author": "schema:author", "creator": "schema:creator", "haspart": "schema:hasPart", "ispartof": "schema:isPartOf", "sameas": "schema:sameAs", "relatedto": "kb:relatedTo", "memberof": "kb:memberOf", "nextstep": "kb:nextStep", "name": "schema:name", "description": "schema:description"}


@dataclass(frozen=True)
class Options:
    base: str = BASE
    entry_types: tuple[str, ...] = ()
    profile: str = ""
    reify: bool = False
    strict: bool = False  # front matter that can't be read raises; else its document is left out, and told of in diagnostics
    prefixes: dict = field(default_factory=lambda: dict(PREFIXES))


#: What documents of a kind are typed as besides articles.
PRESETS = {k: Options(entry_types=(t,), profile=k) for k, t in {"documentation": "schema:TechArticle", "capability-workflow": "schema:HowTo", "runbook": "schema:HowTo", "decision-log": "schema:Report", "service-catalog": "schema:Service"}.items()}
_TEXT = {"schema:name": 1.0, "schema:description": 0.8, "schema:keywords": 0.8}
_PLAIN = Profile(text=_TEXT, relations={}, expansions={}, mode="all")
_WORKFLOW = Profile(text=_TEXT, mode="all")
#: How documents of a kind are searched: those about steps along their relations too.
SEARCH_PRESETS = {"documentation": _PLAIN, "capability-workflow": _WORKFLOW, "runbook": _WORKFLOW, "decision-log": _PLAIN, "service-catalog": _PLAIN}


def many(value: Any) -> list:
    """List items; a string is split on commas; equal ones (letter case aside) once."""
    items = value if isinstance(value, list) else [value]
    out, seen = [], set()
    for x in items:
        for y in [p.strip() for p in x.split(",")] if isinstance(x, str) else [x]:
            key = str(y).lower()
            if y not in (None, "") and key not in seen:
                seen.add(key)
                out.append(y)
    return out


def document_id(path: str, content: str, fields: dict, canonical: str | None, base: str) -> str:
    if canonical:
        return canonical
    if fields.get("canonicalurl"):
        return str(fields["canonicalurl"])
    if not path.strip():
        return f"{base}document/{hashlib.sha256(content.encode()).hexdigest()[:16]}"
    path = re.sub(r"(?i)^content/", "", re.sub(r"^(?:\./|/)+", "", path.replace("\\", "/")))
    return base + re.sub(r"\.[A-Za-z0-9]+$", "", path) + "/"


def title_of(path: str, fields: dict, sections: list[dict]) -> str:
    if str(fields.get("title") or "").strip():
        return str(fields["title"]).strip()
    heading = next((s["heading"] for s in sections if s["heading"]), None)
    return heading or re.sub(r"[-_]", " ", re.sub(r"\.[A-Za-z0-9]+$", "", path.rsplit("/", 1)[-1]))


def _date(value: Any) -> tuple[str, str]:
    if isinstance(value, datetime.date):
        return value.strftime("%Y-%m-%d"), XSD + "date"
    try:
        return datetime.datetime.fromisoformat(str(value).strip()).strftime("%Y-%m-%d"), XSD + "date"
    except ValueError:
        return str(value), XSD + "string"


class _Writer:
    def __init__(self, options: Options) -> None:
        self.o, self.rows, self.problems = options, [], []

    def link(self, s: str, p: str, o: str) -> None:
        self.rows.append((s, "iri", iri(p, self.o.prefixes), o, "iri", None, None))

    def text(self, s: str, p: str, o: Any, dt: str = XSD + "string") -> None:
        if str(o).strip():
            self.rows.append((s, "iri", iri(p, self.o.prefixes), str(o).strip(), "literal", dt, None))

    def entity(self, item: Any, kind: str, source: str) -> str | None:
        """The node of a label, an address or a map of label, type, id and sameAs."""
        e = item if isinstance(item, dict) else {"label": item}
        low = {str(k).lower().replace("_", ""): v for k, v in e.items()}
        label = str(low.get("label") or low.get("name") or low.get("value") or "").strip()
        node = str(low.get("id") or "").strip()
        if not node and re.match(r"(?i)(https?|urn):", label):
            node, label = label, ""
        if not label and not node:
            self.problems.append(f"entity without label or id: {item!r}")
            return None
        node = self.resolve(node) if node else f"{self.o.base}id/{slug_of(label)}"
        kind = str(low.get("type") or kind)
        self.link(node, "rdf:type", iri(kind, self.o.prefixes) if ":" in kind else PREFIXES["schema"] + slug_of(kind))
        if label:
            self.text(node, "schema:name", label)
        for same in many(low.get("sameas") or []):
            self.link(node, "schema:sameAs", str(same))
        self.link(node, "prov:wasDerivedFrom", source)
        return node

    def resolve(self, name: str) -> str:
        if re.match(r"[a-z]+:", name):
            return iri(name, self.o.prefixes)
        return f"{self.o.base}id/{slug_of(name)}"

    def predicate(self, name: str) -> str | None:
        key = re.sub(r"[^a-z]", "", name.lower())
        if ":" in name:
            return iri(name, self.o.prefixes)
        return iri(ALIASES[key]) if key in ALIASES else None


def of_document(path: str, content: str, canonical: str | None = None, options: Options = Options()) -> tuple[list[tuple], list[str]]:
    """Triples of one document, and what was wrong with its authored graph entries."""
    content = content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    try:
        fields, body = documents.front_matter(content)
    except ValueError as e:
        if options.strict:
            raise
        return [], [f"front matter: {e}"]
    sections = documents.outline(body)
    if not fields and not body.strip():
        return [], []
    own = {**options.prefixes, **{str(k): str(v) for k, v in (fields.get("rdfprefixes") or {}).items()}}
    options = replace(options, prefixes=own)
    w, doc = _Writer(options), document_id(path, content, fields, canonical, options.base)
    w.link(doc, "rdf:type", iri("schema:Article"))
    for t in [*options.entry_types, *many(fields.get("rdftypes") or [])]:
        w.link(doc, "rdf:type", iri(str(t), own))
    w.text(doc, "schema:name", title_of(path, fields, sections))
    w.link(doc, "prov:wasDerivedFrom", doc)
    for key, p in (("entrytype", "kb:entryType"), ("sourceproject", "kb:sourceProject")):
        if fields.get(key):
            w.text(doc, p, fields[key])
    w.text(doc, "schema:description", fields.get("summary") or fields.get("description") or "")
    for key, p in (("datepublished", "schema:datePublished"), ("datemodified", "schema:dateModified")):
        if fields.get(key):
            w.text(doc, p, *_date(fields[key]))
    for tag in many([*many(fields.get("tags") or []), *many(fields.get("keywords") or [])]):
        w.text(doc, "schema:keywords", tag)
    for key, p, kind in (("about", "schema:about", "schema:DefinedTerm"), ("author", "schema:author", "schema:Person"), ("entityhints", "schema:mentions", "schema:Thing"), ("graphgroups", "kb:memberOf", "schema:DefinedTerm"), ("graphrelated", "kb:relatedTo", "schema:Thing"), ("graphnextsteps", "kb:nextStep", "schema:Thing")):
        for item in many(fields.get(key) or []):
            if node := w.entity(item, kind, doc):
                w.link(doc, p, node)
    for item in many(fields.get("graphentities") or []):
        w.entity(item, "schema:Thing", doc)
    for edge in many(fields.get("graphedges") or []):
        if not isinstance(edge, dict) or not all(str(edge.get(k) or "").strip() for k in ("subject", "predicate", "object")):
            w.problems.append(f"edge without subject, predicate or object: {edge!r}")
            continue
        p = w.predicate(str(edge["predicate"]))
        if p is None:
            w.problems.append(f"unknown predicate: {edge['predicate']}")
            continue
        w.link(doc if edge["subject"] == "<ARTICLE_ID>" else w.resolve(str(edge["subject"])), p, w.resolve(str(edge["object"])))
    for p, value in (fields.get("rdfproperties") or {}).items():
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, dict) and v.get("id"):
                w.link(doc, str(p), w.resolve(str(v["id"])))
            elif isinstance(v, dict):
                w.text(doc, str(p), v.get("value"), iri(str(v.get("datatype") or "xsd:string"), own))
            else:
                w.text(doc, str(p), str(v).lower() if isinstance(v, bool) else v, XSD + ("boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string"))
    return w.rows, w.problems


def authored(sources: DataFrame, options: Options = Options()) -> DataFrame:
    """Triples of (path, content[, canonical]) rows."""
    canonical = F.col("canonical") if "canonical" in sources.columns else F.lit(None).cast("string")

    return flat_map(sources.select("path", "content", canonical.alias("canonical")), lambda p, c, k: of_document(p or "", c or "", k or None, options)[0], SCHEMA)


def named(sources: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, doc_id) of (path, content[, canonical]) rows: the node of each document."""
    canonical = F.col("canonical") if "canonical" in sources.columns else F.lit(None).cast("string")

    def name(p: str | None, c: str | None, k: str | None) -> list[tuple]:
        try:
            fields, _ = documents.front_matter((c or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
        except ValueError:
            fields = {}
        return [(p, document_id(p or "", c or "", fields, k or None, options.base))]

    return flat_map(sources.select("path", "content", canonical.alias("canonical")), name, "path string, doc_id string")


def diagnostics(sources: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, problem) of authored graph entries that were left out."""

    return flat_map(sources.select("path", "content"), lambda p, c: [(p, x) for x in of_document(p or "", c or "", None, options)[1]], "path string, problem string")


def reified(g: DataFrame, confidence: float = 1.0) -> DataFrame:
    """A statement node with its parts and confidence for every link; its id is a hash of them."""
    at = F.concat(F.lit("_:st"), F.substring(F.sha2(F.concat_ws("\n", "s", "p", "o"), 256), 1, 16))
    rdf, none = PREFIXES["rdf"], F.lit(None).cast("string")
    iri_part = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"))
    parts = F.array(iri_part(TYPE, F.lit(rdf + "Statement")), iri_part(rdf + "subject", F.col("s")), iri_part(rdf + "predicate", F.col("p")), iri_part(rdf + "object", F.col("o")), F.struct(F.lit(iri("kb:confidence")).alias("p"), F.lit(str(confidence)).alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD + "double").alias("o_dt")))
    out = g.where("o_kind = 'iri'").where(F.col("p") != TYPE).select(at.alias("s"), F.lit("blank").alias("s_kind"), F.inline(parts))
    return out.withColumn("o_lang", none).select(*COLUMNS)


def ontology(g: DataFrame) -> DataFrame:
    """The vocabulary's header, classes and properties, and the class of every document."""
    kb = [("kb:Ontology", "rdf:type", "owl:Ontology")]
    kb += [(f"kb:{c}", "rdf:type", "owl:Class") for c in ("MarkdownDocument", "KnowledgeAssertion", "KnowledgeConcept", "KnowledgeSection")]
    kb += [(f"kb:{p}", "rdf:type", "owl:ObjectProperty") for p in ("memberOf", "relatedTo", "nextStep")] + [(f"kb:{p}", "rdf:type", "owl:DatatypeProperty") for p in ("confidence", "entryType", "sourceProject")]
    docs = g.where((F.col("p") == TYPE) & (F.col("o") == iri("schema:Article"))).withColumn("o", F.lit(iri("kb:MarkdownDocument")))
    return union(of_rows(g.sparkSession, kb), docs.select(*COLUMNS))


def concepts(g: DataFrame, base: str = BASE) -> DataFrame:
    """A concept scheme of defined terms and of what documents are about or members of."""
    scheme = base + "concepts"
    typed = g.where((F.col("p") == TYPE) & F.col("o").isin(iri("schema:DefinedTerm"), iri("skos:Concept"), iri("kb:KnowledgeConcept"))).select("s")
    used = g.where(F.col("p").isin(iri("schema:about"), iri("kb:memberOf")) & (F.col("o_kind") == "iri")).select(F.col("o").alias("s"))
    found = typed.unionByName(used).distinct()
    s, to = F.col("s"), F.lit(scheme)
    label = {iri("schema:name"): 1, iri("skos:prefLabel"): 2, iri("rdfs:label"): 3}
    order = F.when(F.col("p") == iri("schema:name"), 1).when(F.col("p") == iri("skos:prefLabel"), 2).otherwise(3)
    names = g.where(F.col("p").isin(*label) & (F.col("o_kind") == "literal")).join(found, "s", "left_semi").groupBy("s").agg(F.min_by("o", F.struct(order, F.col("o"))).alias("label"))
    same = g.where(F.col("p") == iri("schema:sameAs")).join(found, "s", "left_semi")
    head = of_rows(g.sparkSession, [(scheme, "rdf:type", "skos:ConceptScheme")])
    return union(
        head, branch(found, s, "rdf:type", F.lit(iri("skos:Concept")), link=True), branch(found, s, "skos:inScheme", to, link=True), branch(found, s, "skos:topConceptOf", to, link=True),
        branch(found, to, "skos:hasTopConcept", s, link=True), branch(names, s, "skos:prefLabel", F.col("label")), branch(same, s, "skos:exactMatch", F.col("o"), link=True),
    )


def token_facts(sources: DataFrame, options: Options = Options(), topics: int = 8, neighbours: int = 3) -> DataFrame:
    """Sections, segments, topics and related segments found in the texts alone."""
    base = options.base

    def split(path: str, content: str | None) -> Iterator[tuple]:
        try:
            fields, body = documents.front_matter((content or "").replace("\r\n", "\n"))
        except ValueError:
            if options.strict:
                raise
            return
        doc, n = document_id(path or "", content or "", fields, None, base), 0
        for sec in documents.outline(body):
            if not sec["text"]:
                continue
            section = f"{base}token-section/{slug_of(path)}-{sec['ord']}"
            for line in (x.strip() for x in sec["text"].split("\n")):
                if line:
                    yield (doc, section, sec["heading"] or title_of(path, fields, []), f"{base}token-segment/{slug_of(path)}-{n}", line)
                    n += 1

    parts = flat_map(sources.select("path", "content"), split, "doc string, section string, heading string, segment string, text string")
    phrases = terms.keyphrases(parts, topics, id_col="segment")
    topic = F.concat(F.lit(base + "token-topic/"), F.substring(F.sha2("phrase", 256), 1, 16))
    c = F.col
    near = terms.related(parts, neighbours, id_col="segment")
    sections = parts.select("doc", "section", "heading").distinct()
    return union(
        branch(sections, c("doc"), "schema:hasPart", c("section"), link=True), branch(sections, c("section"), "schema:name", c("heading")), branch(sections, c("section"), "rdf:type", F.lit(iri("kb:KnowledgeSection")), link=True),
        branch(parts, c("section"), "schema:hasPart", c("segment"), link=True), branch(parts, c("doc"), "schema:mentions", c("segment"), link=True), branch(parts, c("segment"), "schema:text", c("text")), branch(parts, c("segment"), "rdf:type", F.lit(iri("schema:CreativeWork")), link=True),
        branch(phrases, c("doc_id"), "schema:about", topic, link=True), branch(phrases, topic, "schema:name", c("phrase")), branch(phrases, topic, "rdf:type", F.lit(iri("schema:DefinedTerm")), link=True),
        branch(near, c("doc_id"), "kb:relatedTo", c("related_id"), link=True),
    )


def graph(sources: DataFrame, options: Options = Options(), tokens: bool = False, layers: bool = True) -> DataFrame:
    """The whole graph of a table of sources, as a set."""
    parts = [authored(sources, options)]
    if layers or options.reify:
        parts[0] = written(parts[0])  # the layers read it several times
    if tokens:
        parts.append(token_facts(sources, options))
    if options.reify:
        parts.append(reified(parts[0]))
    if layers:
        base = union(*parts)
        parts += [ontology(base), concepts(base, options.base)]
    return merge(*parts)


def of_fields(spark: SparkSession, document: str, name: str, keywords: Sequence[str] = (), description: str = "", assertions: Sequence[tuple] = (), base: str = BASE) -> DataFrame:
    """Triples of one document from its fields alone. Keywords are one text, joined by commas. ``assertions`` (s, p, o,
    confidence, chunk, start, end) are written as links and as statements with where they were found."""
    w = _Writer(Options(base))
    w.link(document, "rdf:type", iri("schema:Article"))
    w.text(document, "schema:name", name)
    w.text(document, "schema:description", description)
    w.text(document, "schema:keywords", ", ".join(k.strip() for k in keywords if k.strip()))
    for s, p, o, *rest in assertions:
        verb = w.predicate(p)
        if verb is None:
            raise ValueError(f"unknown predicate: {p}")
        s, o = w.resolve(s), w.resolve(o)
        w.link(s, verb, o)
        at = f"{base}assertion/{hashlib.sha256(chr(10).join((s, verb, o)).encode()).hexdigest()[:16]}"
        for q, v in (("rdf:type", iri("kb:KnowledgeAssertion")), ("rdf:subject", s), ("rdf:predicate", verb), ("rdf:object", o), ("prov:wasDerivedFrom", document)):
            w.link(at, q, v)
        for q, v, dt in zip(("kb:confidence", "kb:chunk", "kb:startOffset", "kb:endOffset"), rest, ("double", "string", "integer", "integer")):
            if v is not None:
                w.text(at, q, v, XSD + dt)
    return spark.createDataFrame(w.rows, SCHEMA).dropDuplicates(COLUMNS)
