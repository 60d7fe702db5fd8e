"""Shape constraints as DataFrame plans: each gives rows (shape, focus, path, message) for what violates it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triples import PREFIXES, TYPE, XSD, iri, union


@dataclass(frozen=True)
class Shape:
    """One property shape. The target is a class, or the subjects of a predicate."""

    name: str
    path: str
    target_class: str | None = None
    target_subjects_of: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    node_kind: str | None = None  # iri, literal or blank
    datatype: str | None = None
    least: float | None = None
    most: float | None = None
    has_value: str | None = None

    def focus(self, g: DataFrame) -> DataFrame:
        test = (F.col("p") == TYPE) & (F.col("o") == iri(self.target_class)) if self.target_class else F.col("p") == iri(self.target_subjects_of or "")
        return g.where(test).select(F.col("s").alias("focus")).distinct()


def validate(g: DataFrame, shapes: Sequence[Shape]) -> DataFrame:
    """(shape, focus, path, message, value): one grouped join of targets and values a shape, for all its constraints."""
    return union(*[_violations(g, s) for s in shapes])


def _violations(g: DataFrame, shape: Shape) -> DataFrame:
    values = g.where(F.col("p") == iri(shape.path)).select(F.col("s").alias("focus"), "o", "o_kind", F.when(F.col("o_kind") == "literal", F.coalesce("o_dt", F.lit(XSD + "string"))).alias("dt"), F.lit(1).alias("there"))
    joined = shape.focus(g).join(values, "focus", "left")
    number = F.col("o").try_cast("double")
    each: list[tuple[str, Column]] = []
    if shape.node_kind:
        each.append(("nodeKind", F.col("o_kind") != shape.node_kind))
    if shape.datatype:
        each.append(("datatype", ~F.col("dt").eqNullSafe(iri(shape.datatype))))
    if shape.least is not None:
        each.append(("minInclusive", F.coalesce(number < shape.least, F.lit(True))))
    if shape.most is not None:
        each.append(("maxInclusive", F.coalesce(number > shape.most, F.lit(True))))
    out = []
    row = lambda df, message, value: df.select(F.lit(shape.name).alias("shape"), "focus", F.lit(iri(shape.path)).alias("path"), message.alias("message"), value.cast("string").alias("value"))
    if each:
        failed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in each]), lambda x: x.isNotNull())
        out.append(row(joined.where("there = 1").withColumn("message", F.explode(failed)), F.col("message"), F.col("o")))
    counts = []
    if shape.min_count is not None:
        counts.append(("minCount", F.col("n") < shape.min_count))
    if shape.max_count is not None:
        counts.append(("maxCount", F.col("n") > shape.max_count))
    if shape.has_value is not None:
        counts.append(("hasValue", F.col("hits") == 0))
    if counts:
        wanted = F.col("o") == (iri(shape.has_value) if shape.has_value and shape.has_value.partition(":")[0] in PREFIXES else shape.has_value or "")
        n = joined.groupBy("focus").agg(F.count("there").alias("n"), F.count_if(wanted).alias("hits"))
        failed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in counts]), lambda x: x.isNotNull())
        out.append(row(n.withColumn("message", F.explode(failed)), F.col("message"), F.col("n")))
    if not out:
        raise ValueError(f"shape {shape.name} has no constraint")
    return union(*out)


def contract(required: Sequence[str], facets: Sequence[str] = (), links: Sequence[str] = (), target: str = "schema:Article") -> list[Shape]:
    """Shapes of a search contract: required texts and facets, and links that must be nodes where they occur."""
    return [
        *[Shape(f"required {p}", p, target, min_count=1, node_kind="literal") for p in required],
        *[Shape(f"facet {p}", p, target, min_count=1) for p in facets],
        *[Shape(f"link {p}", p, target, node_kind="iri") for p in links],
    ]


_ENTITIES = ("Thing", "Person", "Organization", "SoftwareApplication", "CreativeWork", "DefinedTerm")
DEFAULT = [
    Shape("article name", "schema:name", "schema:Article", min_count=1, node_kind="literal"),
    Shape("article source", "prov:wasDerivedFrom", "schema:Article", min_count=1, node_kind="iri"),
    *[Shape(f"{c} name", "schema:name", f"schema:{c}", min_count=1, node_kind="literal") for c in _ENTITIES],
    Shape("same as", "schema:sameAs", target_subjects_of="schema:sameAs", node_kind="iri"),
    Shape("source", "prov:wasDerivedFrom", target_subjects_of="prov:wasDerivedFrom", node_kind="iri"),
    *[Shape(f"statement {p}", f"rdf:{p}", "rdf:Statement", min_count=1, max_count=1, node_kind="iri") for p in ("subject", "predicate", "object")],
    Shape("statement confidence", "kb:confidence", "rdf:Statement", min_count=1, max_count=1),
    Shape("confidence", "kb:confidence", target_subjects_of="kb:confidence", least=0, most=1),
]


def report(violations: DataFrame) -> DataFrame:
    """(line): the report as triples in line syntax, one result a violation."""
    sh = PREFIXES["sh"]
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    at = F.concat(F.lit("_:r"), F.substring(F.sha2(F.concat_ws("\n", "shape", "focus", "path", "message", "value"), 256), 1, 16))
    lines = F.array(
        F.concat(at, F.lit(f" <{sh}focusNode> <"), "focus", F.lit("> .")),
        F.concat(at, F.lit(f" <{sh}resultPath> <"), "path", F.lit("> .")),
        F.concat(at, F.lit(f" <{sh}resultMessage> "), quoted("message"), F.lit(" .")),
    )
    return violations.select(F.explode(lines).alias("line"))
