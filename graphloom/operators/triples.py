"""The graph model: a set of triples as a DataFrame, tabular mappings onto it, and whole-graph operators.

Columns: s, s_kind, p, o, o_kind, o_dt, o_lang; kinds are ``iri``, ``blank`` and ``literal``. A graph mapped from tables is a
union of one branch for each predicate, so a filter on a constant predicate leaves only the branches (and the Parquet
columns) that can match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import written
from .terms import small

COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
XSD = "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": XSD,
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sh": "http://www.w3.org/ns/shacl#",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "https://schema.org/",
    "kb": "urn:graphloom:vocab:",
}
BASE = "urn:graphloom:/"
TYPE = PREFIXES["rdf"] + "type"


def iri(name: str, prefixes: dict[str, str] = PREFIXES) -> str:
    """``prefix:local`` as an IRI; anything else as it is. An unknown prefix without ``//`` or ``urn:`` raises ValueError."""
    head, colon, local = name.partition(":")
    if colon and head in prefixes:
        return prefixes[head] + local
    if name.startswith("urn:") or "://" in name or name.startswith("mailto:"):
        return name
    raise ValueError(f"no such prefix: {name}")


def curie(column: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """IRIs with the longest known namespace written as a prefix."""
    out = column
    for prefix, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(column, F.lit(space)), F.concat(F.lit(prefix + ":"), F.substring(column, F.lit(len(space) + 1), F.length(column)))).otherwise(out)
    return out


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), key.cast("string"))


def branch(df: DataFrame, s: Column, p: str, o: Column, dt: str | None = None, link: bool = False) -> DataFrame:
    """Triples of one predicate; rows with a null object have none. ``link``: objects are nodes."""
    kind, data = ("iri", None) if link else ("literal", XSD + (dt or "string"))
    o = o.cast("string")
    return df.where(o.isNotNull()).select(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(iri(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(data).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def union(*graphs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, graphs)


def merge(*graphs: DataFrame) -> DataFrame:
    """The set union of graphs: one shuffle."""
    return union(*graphs).dropDuplicates(COLUMNS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def of_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Triples from (s, p, o) with prefixed names; an object that is a str without a colon-prefix known, or a number, is a literal."""
    out = []
    for s, p, o in rows:
        if isinstance(o, bool):
            obj = (str(o).lower(), "literal", XSD + "boolean")
        elif isinstance(o, int | float):
            obj = (repr(o), "literal", XSD + ("integer" if isinstance(o, int) else "double"))
        elif isinstance(o, tuple):
            obj = (o[0], "literal", iri(o[1]))
        elif o.partition(":")[0] in PREFIXES or o.startswith("urn:") or "://" in o:
            obj = (iri(o), "iri", None)
        else:
            obj = (o, "literal", XSD + "string")
        out.append((iri(s), "iri", iri(p), *obj, None))
    return spark.createDataFrame(out, SCHEMA)


# -- tables as graphs


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers, customers, parts, orders and order lines as one graph."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}
    c = F.col
    region, nation, supplier, customer = node("region", c("r_regionkey")), node("nation", c("n_nationkey")), node("supplier", c("s_suppkey")), node("customer", c("c_custkey"))
    part, order = node("part", c("p_partkey")), node("order", c("o_orderkey"))
    line = F.concat(node("line", c("l_orderkey")), F.lit("-"), c("l_linenumber"), F.lit("-"), c("l_partkey"), F.lit("-"), c("l_suppkey"))
    typed = lambda df, s, kind: branch(df, s, "rdf:type", F.lit(PREFIXES["kb"] + kind), link=True)
    return union(
        typed(t["region"], region, "Region"), branch(t["region"], region, "schema:name", c("r_name")),
        typed(t["nation"], nation, "Nation"), branch(t["nation"], nation, "schema:name", c("n_name")),
        branch(t["nation"], nation, "kb:memberOf", node("region", c("n_regionkey")), link=True),
        branch(t["nation"], nation, "skos:broader", node("region", c("n_regionkey")), link=True),
        typed(t["supplier"], supplier, "Supplier"), branch(t["supplier"], supplier, "schema:name", c("s_name")),
        branch(t["supplier"], supplier, "kb:memberOf", node("nation", c("s_nationkey")), link=True),
        branch(t["supplier"], supplier, "kb:balance", c("s_acctbal"), "double"),
        typed(t["customer"], customer, "Customer"), branch(t["customer"], customer, "schema:name", c("c_name")),
        branch(t["customer"], customer, "kb:memberOf", node("nation", c("c_nationkey")), link=True),
        branch(t["customer"], customer, "kb:balance", c("c_acctbal"), "double"),
        branch(t["customer"], customer, "kb:segment", c("c_mktsegment")),
        branch(t["part"], part, "rdf:type", F.concat(F.lit(PREFIXES["kb"]), c("p_type")), link=True),
        branch(t["part"], part, "schema:name", c("p_name")), branch(t["part"], part, "kb:brand", c("p_brand")),
        branch(t["part"], part, "kb:size", c("p_size"), "integer"), branch(t["part"], part, "kb:price", c("p_retailprice"), "double"),
        typed(t["orders"], order, "Order"), branch(t["orders"], order, "schema:customer", node("customer", c("o_custkey")), link=True),
        branch(t["orders"], order, "kb:status", c("o_orderstatus")), branch(t["orders"], order, "kb:priority", c("o_orderpriority")),
        branch(t["orders"], order, "kb:total", c("o_totalprice"), "double"),
        branch(t["lineitem"], node("order", c("l_orderkey")), "schema:hasPart", line, link=True),
        branch(t["lineitem"], line, "kb:part", node("part", c("l_partkey")), link=True),
        branch(t["lineitem"], line, "kb:supplier", node("supplier", c("l_suppkey")), link=True),
        branch(t["lineitem"], line, "kb:quantity", c("l_quantity"), "double"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their labels and conversations as one graph."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = F.col
    doc, turn = node("document", c("doc_id")), F.concat(node("turn", c("conv_id")), F.lit("-"), c("turn"))
    after = F.concat(node("turn", c("conv_id")), F.lit("-"), c("turn") + 1)
    last = Window.partitionBy("conv_id")
    ends = talk.withColumn("last", F.max("turn").over(last))
    return union(
        branch(docs, doc, "rdf:type", F.lit(iri("schema:Article")), link=True),
        branch(docs, doc, "schema:name", F.trim(F.element_at(F.split("text", "\n"), 1))),
        branch(docs, doc, "schema:inLanguage", c("lang")), branch(docs, doc, "kb:sourceProject", c("source")),
        branch(docs, doc, "prov:wasDerivedFrom", doc, link=True), branch(docs, doc, "schema:text", c("text")),
        branch(labels, doc, "kb:quality", c("quality"), "integer"), branch(labels, doc, "kb:toxic", c("toxic"), "integer"),
        branch(talk, turn, "rdf:type", F.lit(iri("kb:Turn")), link=True), branch(talk, turn, "kb:role", c("role")),
        branch(talk, node("conversation", c("conv_id")), "schema:hasPart", turn, link=True),
        branch(ends.where("turn < last"), turn, "kb:nextStep", after, link=True),
    )


# -- whole graphs


def type_census(g: DataFrame) -> DataFrame:
    return g.where(F.col("p") == TYPE).groupBy(F.col("o").alias("type")).agg(F.count("*").alias("n"))


def predicate_census(g: DataFrame) -> DataFrame:
    return g.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"), F.count_if(F.col("o_kind") == "literal").alias("n_literal"), F.count_if(F.col("o_kind") != "literal").alias("n_resource"))


def nodes(g: DataFrame) -> DataFrame:
    """(node) of every subject and resource object."""
    return g.select(F.col("s").alias("node")).unionByName(g.where("o_kind <> 'literal'").select(F.col("o").alias("node"))).distinct()


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Triples in only one of two graphs, with ``change`` added or removed: one shuffle for both directions."""
    sides = before.withColumn("side", F.lit(1)).unionByName(after.withColumn("side", F.lit(2)))
    once = sides.groupBy(*COLUMNS).agg(F.bit_or("side").alias("side")).where("side < 3")
    return once.select(*COLUMNS, F.when(F.col("side") == 1, "removed").otherwise("added").alias("change"))


def node_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    sides = nodes(before).withColumn("side", F.lit(1)).unionByName(nodes(after).withColumn("side", F.lit(2)))
    return sides.groupBy("node").agg(F.bit_or("side").alias("side")).where("side < 3").select("node", F.when(F.col("side") == 1, "removed").otherwise("added").alias("change"))


def changed_literals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(s, p, old, new): removed against added literals of the same subject and predicate."""
    d = edge_diff(before, after).where("o_kind = 'literal'")
    gathered = d.groupBy("s", "p").agg(*[F.collect_list(F.when(F.col("change") == k, F.col("o"))).alias(k) for k in ("removed", "added")])
    return gathered.select("s", "p", F.explode("removed").alias("old"), "added").select("s", "p", "old", F.explode("added").alias("new"))


def change_set(before: DataFrame, after: DataFrame, key: str = "path", print_col: str = "fingerprint") -> DataFrame:
    """(key, change) between two manifests: changed (new or different), unchanged, removed."""
    a, b = before.select(key, F.col(print_col).alias("fa")), after.select(key, F.col(print_col).alias("fb"))
    change = F.when(F.col("fb").isNull(), "removed").when(F.col("fa").isNull() | (F.col("fa") != F.col("fb")), "changed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All pairs joined by one or more edges, cycles included.

    Paths double in length each round, so there are as many rounds as the logarithm of the longest; a round is written
    to the shared folder, and the last is the one that finds nothing new.
    """
    known = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    n = known.count()
    while True:
        step = known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        grown = written(known.unionByName(step).distinct())
        more = grown.count()
        if more == n:
            return grown
        known, n = grown, more


def fixpoint(g: DataFrame, rules: list, most: int = 100) -> DataFrame:
    """``g`` with all that ``rules`` (graph -> new triples) add, until nothing new comes. g itself is not changed."""
    g = written(g.dropDuplicates(COLUMNS))
    for _ in range(most):
        new = written(union(*[r(g) for r in rules]).select(*COLUMNS).dropDuplicates(COLUMNS).join(g, ["s", "p", "o", "o_kind"], "left_anti").select(*COLUMNS))
        if new.isEmpty():
            return g
        g = written(g.unionByName(new))
    raise RuntimeError("the rules do not settle")


def rdfs(g: DataFrame) -> DataFrame:
    """Entailment of subClassOf, subPropertyOf, domain and range: (only) the triples that are new.

    The schema's closures are taken once; then properties, domains and ranges, and classes each need one join.
    """
    pairs = lambda p: g.where((F.col("p") == iri(p)) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    sub_class, sub_property = closure(pairs("rdfs:subClassOf")), closure(pairs("rdfs:subPropertyOf"))
    lifted = g.join(sub_property, F.col("p") == F.col("a")).select("s", "s_kind", F.col("b").alias("p"), "o", "o_kind", "o_dt", "o_lang")
    wide = g.unionByName(lifted)
    none = F.lit(None).cast("string")
    typed = lambda df, s, kind, t: df.select(F.col(s).alias("s"), F.col(kind).alias("s_kind"), F.lit(TYPE).alias("p"), F.col(t).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    domain = typed(wide.join(pairs("rdfs:domain"), F.col("p") == F.col("a")), "s", "s_kind", "b")
    ranged = typed(wide.where("o_kind <> 'literal'").join(pairs("rdfs:range"), F.col("p") == F.col("a")), "o", "o_kind", "b")
    types = union(wide.where(F.col("p") == TYPE), domain, ranged)
    raised = typed(types.join(sub_class, F.col("o") == F.col("a")), "s", "s_kind", "b")
    classes = lambda c, p: c.select(F.col("a").alias("s"), F.lit("iri").alias("s_kind"), F.lit(iri(p)).alias("p"), F.col("b").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    new = union(lifted, domain, ranged, raised, classes(sub_class, "rdfs:subClassOf"), classes(sub_property, "rdfs:subPropertyOf")).dropDuplicates(COLUMNS)
    return new.join(g, ["s", "p", "o", "o_kind"], "left_anti").select(*COLUMNS)


def skos(g: DataFrame) -> DataFrame:
    """Triples whose object is a concept, repeated with every broader concept: the new ones."""
    broader = closure(g.where(F.col("p") == iri("skos:broader")).select(F.col("s").alias("a"), F.col("o").alias("b")))
    raised = g.where("o_kind <> 'literal'").join(small(broader), F.col("o") == F.col("a")).select("s", "s_kind", "p", F.col("b").alias("o"), "o_kind", "o_dt", "o_lang").dropDuplicates(COLUMNS)
    # only triples whose object is a broader concept can be there already
    there = g.where("o_kind <> 'literal'").join(small(broader.select(F.col("b").alias("o")).distinct()), "o", "left_semi")
    return raised.join(there, ["s", "p", "o", "o_kind"], "left_anti").select(*COLUMNS)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each connected component, by alternating star contractions.

    Rounds grow with the logarithm of the longest path, and each is two shuffles of the edges that are left.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = written(both(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")).distinct())
    last = None
    while True:
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = e.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        toward = both(large).where("b < a")
        low = toward.groupBy("a").agg(F.min("b").alias("m"))
        small = toward.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        star_edges = written(small)
        sign = star_edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == last:
            roots = star_edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return star_edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()
        last, e = sign, written(both(star_edges).distinct())
