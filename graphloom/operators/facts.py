"""Facts by a model: extraction from chunks, cached; normalising, merging by aliases, and their triples.

A model is any function from (document, chunk text) to a payload: a map, or JSON text of one, with ``entities`` (id,
label, type, sameAs) and ``assertions`` (s, p, o, confidence, source). It runs in Arrow batches beside the chunks. A row
of the cache is a chunk's payload under a key of the chunk and of what made it; only chunks without one are extracted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rows import flat_map
from graphloom.functions.text import slug
from graphloom.operators import triples as T
from graphloom.operators.build import ALIASES
from graphloom.operators.lineage import written

ENTITY = "struct<id:string,label:string,type:string,same_as:array<string>>"
ASSERTION = "struct<s:string,p:string,o:string,confidence:double,source:string>"
ARTICLE, SOURCE = "<ARTICLE_ID>", "__SOURCE__"
#: Types by how much they say; others come between.
_PRIORITY = {"schema:Thing": 0, "schema:CreativeWork": 1}


def payload(made: object) -> dict:
    """A model's answer as a map; text in code fences is taken out of them. What isn't a map raises ValueError."""
    if isinstance(made, str):
        text = made.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
        made = json.loads(text)
    if not isinstance(made, dict):
        raise ValueError("a payload must be a map")
    return made


def _field(item: dict, *names: str) -> object:
    low = {str(k).lower().replace("_", ""): v for k, v in item.items()}
    return next((low[n] for n in names if low.get(n) is not None), None)


def extract(chunks: DataFrame, model: Callable[[str, str], object], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, payload, problem) of chunks (doc_id, ord, text): the model's answers as JSON text.

    A chunk whose answer can't be read has a problem instead of a payload; a blank chunk isn't asked about."""

    def ask(d: str, n: int, t: str) -> list[tuple]:
        try:
            return [(d, n, json.dumps(payload(model(d, t)), ensure_ascii=False), None)]
        except (ValueError, TypeError, AttributeError) as e:
            return [(d, n, None, str(e))]

    asked = chunks.select(F.col(doc).cast("string").alias("doc_id"), F.col("ord").cast("bigint").alias("ord"), F.col(text).alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return flat_map(asked, ask, "doc_id string, ord bigint, payload string, problem string")


def cached(chunks: DataFrame, model: Callable[[str, str], object], cache: str, *made_by: str) -> DataFrame:
    """``extract`` with a cache: a Parquet folder of (key, payload). ``made_by`` names the chunker, prompt and model.

    New answers are added in one append, which is whole or not at all; answers that can't be read aren't kept."""
    spark = chunks.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    key = F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), *[F.lit(x) for x in made_by], "text"), 256)
    keyed = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("ord").cast("bigint").alias("ord"), "text", key.alias("key"))
    known = spark.read.schema("key string, payload string").parquet(cache) if there else spark.createDataFrame([], "key string, payload string")
    known = known.groupBy("key").agg(F.min("payload").alias("payload"))
    new = written(extract(keyed.join(known, "key", "left_anti"), model).join(keyed.select("doc_id", "ord", "key"), ["doc_id", "ord"]))
    new.where("payload IS NOT NULL").select("key", "payload").distinct().write.mode("append").parquet(cache)
    old = keyed.join(known, "key").select("doc_id", "ord", "payload", F.lit(None).cast("string").alias("problem"))
    return old.unionByName(new.select("doc_id", "ord", "payload", "problem"))


def _clean(value: object) -> str:
    return str(value).strip() if value is not None else ""


def _listed(text: str) -> tuple[list[dict], list[dict]]:
    made = json.loads(text)
    entities, assertions = [], []
    for e in _field(made, "entities") or []:
        if isinstance(e, dict) and _clean(_field(e, "label", "name")):
            same = _field(e, "sameas") or []
            same = [same] if isinstance(same, str) else same
            entities.append({"id": _clean(_field(e, "id")) or None, "label": _clean(_field(e, "label", "name")), "type": _clean(_field(e, "type")) or None, "same_as": list(dict.fromkeys(_clean(x) for x in same if _clean(x)))})
    for a in _field(made, "assertions") or []:
        if isinstance(a, dict):
            confidence = _field(a, "confidence")
            try:
                confidence = None if confidence is None else float(confidence)
            except (TypeError, ValueError):
                confidence = None
            assertions.append({"s": _clean(_field(a, "s", "subject", "subjectid")), "p": _clean(_field(a, "p", "predicate")), "o": _clean(_field(a, "o", "object", "objectid")), "confidence": confidence, "source": _clean(_field(a, "source"))})
    return entities, assertions


def parsed(answers: DataFrame) -> DataFrame:
    """(doc_id, ord, entities, assertions) of answers (doc_id, ord, payload)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [_listed(t) if t else ([], []) for t in texts]
            yield pd.DataFrame({"entities": [r[0] for r in rows], "assertions": [r[1] for r in rows]})

    read = F.pandas_udf(run, f"entities array<{ENTITY}>, assertions array<{ASSERTION}>")
    return answers.select("doc_id", "ord", read("payload").alias("x")).select("doc_id", "ord", "x.entities", "x.assertions")


def sure(confidence: Column) -> Column:
    """A confidence within 0 and 1; 0.5 where there is none or no number."""
    return F.when(confidence.isNull() | F.isnan(confidence), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)))


def node_id(name: Column, base: str = T.BASE) -> Column:
    """An absolute name as it is, any other as the identifier of its slug."""
    name = F.trim(name)
    return F.when(F.rlike(name, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:\S")), name).otherwise(F.concat(F.lit(base + "id/"), slug(name)))


def priority(kind: Column) -> Column:
    out = F.when(kind.isNull() | (kind == ""), 0)
    for k, v in _PRIORITY.items():
        out = out.when(kind == k, v)
    return out.otherwise(2)


def entity_rows(facts: DataFrame, base: str = T.BASE) -> DataFrame:
    """(id, label, type, same_as, confidence, source, ordinal) of parsed answers; ``ordinal`` is by document and chunk."""
    order = F.struct("doc_id", "ord", F.col("n").cast("bigint"))
    rows = facts.select("doc_id", "ord", F.posexplode("entities").alias("n", "e"))
    return rows.select(node_id(F.coalesce("e.id", "e.label"), base).alias("id"), F.col("e.label").alias("label"), F.coalesce("e.type", F.lit("schema:Thing")).alias("type"), F.coalesce("e.same_as", F.array().cast("array<string>")).alias("same_as"), F.lit(1.0).alias("confidence"), F.col("doc_id").alias("source"), order.alias("ordinal"))


def assertion_rows(facts: DataFrame, base: str = T.BASE) -> DataFrame:
    """(s, p, o, confidence, source, ordinal) of parsed answers; the article's placeholder is its document's id.

    Assertions without subject, predicate or object are left out, as are predicates that have no IRI."""
    rows = facts.select("doc_id", "ord", F.posexplode("assertions").alias("n", "a")).where("a.s <> '' AND a.p <> '' AND a.o <> ''")
    at = lambda c: F.when(F.col(c) == ARTICLE, F.col("doc_id")).otherwise(node_id(F.col(c), base))
    source = F.when(F.col("a.source").isin("", SOURCE), F.col("doc_id")).otherwise(F.col("a.source"))
    out = rows.select(at("a.s").alias("s"), predicate(F.col("a.p")).alias("p"), at("a.o").alias("o"), sure(F.col("a.confidence")).alias("confidence"), source.alias("source"), F.struct("doc_id", "ord", F.col("n").cast("bigint")).alias("ordinal"))
    return out.where("p IS NOT NULL")


def predicate(name: Column) -> Column:
    """The IRI of an alias or a prefixed name; null for an unknown one."""
    key, out = F.regexp_replace(F.lower(name), "[^a-z]", ""), F.when(F.rlike(name, F.lit("^(https?://|urn:)")), name)
    for prefix, space in T.PREFIXES.items():
        out = out.when(F.startswith(name, F.lit(prefix + ":")), F.concat(F.lit(space), F.substring(name, F.lit(len(prefix) + 2), F.length(name))))
    for alias, p in ALIASES.items():
        out = out.when(key == alias, T.iri(p))
    return out


def aliases(entities: DataFrame) -> DataFrame:
    """(alias, id): every id and sameAs of an entity with the id that stands for all connected to it: that of the first
    entity (by ordinal) among them. Letter case doesn't matter."""
    low = entities.select(F.lower("id").alias("own"), "id", "same_as", "ordinal")
    links = low.select("own", F.explode(F.array_union(F.array("own"), F.transform("same_as", F.lower))).alias("alias")).distinct()
    parts = T.components(links, "own", "alias")
    every = links.select(F.col("alias").alias("node")).distinct().join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    named = low.join(every, F.col("own") == F.col("node")).groupBy("root").agg(F.min_by("id", "ordinal").alias("id"))
    return every.join(named, "root").select(F.col("node").alias("alias"), "id")


def merge(entities: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id, label, type, same_as, confidence, source), one for each group of aliases: longest label, most telling
    type, union of sameAs, greatest confidence, first source that isn't blank. Assertions (s, p, o, confidence, source),
    once each letter case aside, with subject and object (but that of sameAs) by their entities' ids. And (id, source):
    every source of an entity or a subject, a row each, as a well-known one may have more than fit in a list."""
    names = written(aliases(entities))
    blank = F.trim(F.coalesce("source", F.lit(""))) == ""
    first = F.min_by("source", F.when(~blank, F.col("ordinal"))).alias("source")
    by = entities.join(names.withColumnRenamed("id", "head"), F.lower(F.col("id")) == F.col("alias"))
    merged = by.groupBy("head").agg(
        F.min_by("label", F.struct(-F.length("label"), F.col("ordinal"))).alias("label"), F.min_by("type", F.struct(-priority(F.col("type")), F.col("ordinal"))).alias("type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("same_as")))).alias("same_as"), F.max("confidence").alias("confidence"), first,
    ).withColumnRenamed("head", "id")
    led = lambda c: names.select(F.col("alias").alias(f"a_{c}"), F.col("id").alias(f"i_{c}"))
    same = F.lower("p") == T.iri("schema:sameAs").lower()
    told = assertions.join(led("s"), F.lower("s") == F.col("a_s"), "left").join(led("o"), (F.lower("o") == F.col("a_o")) & ~same, "left")
    told = told.select(F.coalesce("i_s", "s").alias("s"), "p", F.coalesce("i_o", "o").alias("o"), "confidence", "source", "ordinal")
    once = told.groupBy(*[F.lower(c).alias(f"k_{c}") for c in "spo"]).agg(*[F.min_by(c, "ordinal").alias(c) for c in "spo"], F.max("confidence").alias("confidence"), first)
    sources = by.where(~blank).select(F.col("head").alias("id"), "source").unionByName(told.where(~blank).select(F.col("s").alias("id"), "source")).distinct()
    return merged, once.select("s", "p", "o", "confidence", "source"), sources


def as_triples(entities: DataFrame, assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """Triples of merged facts: of entities type, name, confidence, sameAs and provenance; of assertions between absolute
    names the link, with its provenance on the subject."""
    c = F.col
    kind = F.coalesce(predicate(c("type")), F.concat(F.lit(T.PREFIXES["schema"]), c("type")))
    named = entities.select("*", kind.alias("kind"))
    absolute = assertions.where(F.rlike("s", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")) & F.rlike("o", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")))
    none = F.lit(None).cast("string")
    links = absolute.select("s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    return T.merge(
        T.branch(named, c("id"), "rdf:type", c("kind"), link=True), T.branch(named, c("id"), "schema:name", c("label")), T.branch(named, c("id"), "kb:confidence", c("confidence"), "double"),
        T.branch(named.select("id", F.explode("same_as").alias("same")), c("id"), "schema:sameAs", c("same"), link=True),
        T.branch(sources, c("id"), "prov:wasDerivedFrom", c("source"), link=True), links,
    )
