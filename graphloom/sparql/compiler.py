"""The algebra as DataFrames.

A solution column holds a term as struct<k, v, d, l> (kind, value, datatype, language; d and l are empty where there is
none) and is null where unbound. The compiler tracks which variables are bound in every solution: only others need the
compatibility test of nullable columns, all else is an equality that Catalyst can hash or sort on. Errors are nulls, so
SQL's three-valued logic is that of the language. Computed numbers are doubles; whole ones are written as integers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.triples import PREFIXES, XSD, closure

from .parser import Query, QueryError, parse

NUMERIC = [XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]
TERM = "struct<k:string,v:string,d:string,l:string>"
DEFAULT_LIMIT = 100
_LANG_STRING = PREFIXES["rdf"] + "langString"


def term(kind: str | Column, value: Column, datatype: str | Column = "", language: str | Column = "") -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(kind).alias("k"), value.alias("v"), as_col(datatype).alias("d"), as_col(language).alias("l"))


@dataclass
class Val:
    """A compiled expression: t is term, num, bool or str."""

    t: str
    c: Column

    @property
    def num(self) -> Column:
        if self.t == "num":
            return self.c
        if self.t == "bool":
            return F.lit(None).cast("double")
        if self.t == "str":
            return F.lit(None).cast("double")
        return F.when((self.c["k"] == "literal") & self.c["d"].isin(NUMERIC), self.c["v"].try_cast("double"))

    @property
    def text(self) -> Column:
        if self.t == "term":
            return self.c["v"]
        return self.as_term["v"] if self.t == "num" else self.c.cast("string")

    @property
    def truth(self) -> Column:
        if self.t == "bool":
            return self.c
        if self.t == "num":
            return (self.c != 0) & ~F.isnan(self.c)
        if self.t == "str":
            return F.length(self.c) > 0
        return F.when(self.c["k"] == "literal", F.when(self.c["d"] == XSD + "boolean", self.c["v"].isin("true", "1")).when(self.c["d"].isin(NUMERIC), self.num != 0).otherwise(F.length(self.c["v"]) > 0))

    @property
    def as_term(self) -> Column:
        if self.t == "term":
            return self.c
        if self.t == "num":
            whole = (self.c == F.floor(self.c)) & (F.abs(self.c) < 1e15)
            made = term("literal", F.when(whole, self.c.cast("bigint").cast("string")).otherwise(self.c.cast("string")), F.when(whole, XSD + "integer").otherwise(XSD + "double"))
        else:
            made = term("literal", self.c.cast("string"), XSD + ("boolean" if self.t == "bool" else "string"))
        return F.when(self.c.isNotNull(), made)


@dataclass
class Sol:
    """Solutions: bound are the variables that have a value in every row, free the ones that may lack it."""

    df: DataFrame
    bound: frozenset
    free: frozenset = frozenset()

    @property
    def names(self) -> frozenset:
        return self.bound | self.free


def _variables(e: object) -> set:
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    if isinstance(e, tuple | list):
        return set().union(*map(_variables, e)) if e else set()
    return set()


def _sort_keys(v: Val) -> list[Column]:
    t = v.as_term
    rank = F.when(t.isNull(), 0).when(t["k"] == "blank", 1).when(t["k"] == "iri", 2).otherwise(3)
    return [rank, v.num, t["v"]]


class Engine:
    """Runs queries over a triple DataFrame, with other graphs behind service addresses."""

    def __init__(self, graph: DataFrame, services: Mapping[str, DataFrame] | None = None, prefixes: Mapping[str, str] = PREFIXES, allowed: set | None = None) -> None:
        self.graph, self.services, self.prefixes = graph, dict(services or {}), dict(prefixes)
        self.allowed = allowed
        self.spark: SparkSession = graph.sparkSession

    # -- entry points

    def select(self, text: str, limit: int | None = DEFAULT_LIMIT, terms: bool = False) -> DataFrame:
        """One string column a variable (a struct of the whole term if ``terms``); without a LIMIT, the first ``limit`` rows."""
        q = parse(text, self.prefixes)
        if q.form != "select":
            raise QueryError("not a SELECT query")
        names, sol = self.run(q, limit)
        return sol.df.select(*[F.col(n) if terms else F.col(n)["v"].alias(n) for n in names])

    def ask(self, text: str) -> DataFrame:
        """One row with a boolean ``answer``."""
        q = parse(text, self.prefixes)
        if q.form != "ask":
            raise QueryError("not an ASK query")
        return self.pattern(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))

    def run(self, q: Query, limit: int | None = None) -> tuple[list[str], Sol]:
        sol = self.pattern(q.where)
        items = [(n, None) for n in sorted(sol.names) if not n.startswith("__")] if q.star else q.items
        aggregated = bool(q.group) or any(self._has_agg(e) for _, e in items) or any(self._has_agg(e) for e in q.having)
        having, order = q.having, q.order
        if aggregated:
            sol, swap = self.aggregate(sol, q, items)
            items, having, order = [(n, swap(e) if e else None) for n, e in items], [swap(e) for e in having], [(swap(e), d) for e, d in order]
            for e in having:
                sol = self.filter(sol, e)
        for n, e in items:
            if e is not None and e != ("var", n):
                sol = self.extend(sol, n, e)
        names = [n for n, _ in items]
        sol = Sol(sol.df.select("*", *[F.lit(None).cast(TERM).alias(n) for n in names if n not in sol.df.columns]), sol.bound, sol.free | {n for n in names if n not in sol.names})
        if q.distinct:
            sol = Sol(sol.df.select(*names).distinct(), sol.bound & set(names), sol.free & set(names))
        if order:
            keys = []
            for e, down in order:
                keys += [k.desc() if down else k.asc() for k in _sort_keys(self.value(sol, e))]
            sol = Sol(sol.df.orderBy(*keys), sol.bound, sol.free)
        df = sol.df.select(*names)
        if q.offset:
            df = df.offset(q.offset)
        n = q.limit if q.limit is not None else limit
        if n is not None:
            df = df.limit(n)
        return names, Sol(df, sol.bound & set(names), sol.free & set(names))

    # -- patterns

    def pattern(self, p: tuple) -> Sol:
        return getattr(self, "p_" + p[0])(*p[1:])

    def p_unit(self) -> Sol:
        return Sol(self.spark.range(1).select(), frozenset())

    def p_bgp(self, triples: list) -> Sol:
        left = list(triples)
        weight = lambda t: sum(x[0] != "var" for x in t) + (t[1][0] == "iri") + (t[0][0] != "var") - 2 * (t[1][0] == "path")
        sol = None
        while left:
            seen = sol.names if sol else frozenset()
            near = [t for t in left if _variables(list(t)) & seen] or left
            t = max(near, key=weight)
            left.remove(t)
            scan = self.scan(*t)
            sol = scan if sol is None else self.join(sol, scan)
        return sol if sol is not None else self.p_unit()

    def scan(self, s: tuple, p: tuple, o: tuple) -> Sol:
        g = self.graph
        subject = term(F.col("s_kind"), F.col("s"))
        language = F.coalesce("o_lang", F.lit(""))
        data = F.when(F.col("o_kind") != "literal", "").otherwise(F.coalesce("o_dt", F.when(language != "", _LANG_STRING).otherwise(XSD + "string")))
        obj = term(F.col("o_kind"), F.col("o"), data, language)
        if p[0] == "path":
            pairs = self.pairs(p)
            ends = [(s, "a"), (o, "b")]
            for t, c in ends:
                if t[0] != "var":
                    pairs = pairs.where(F.col(c) == self._constant(t))
            columns = [(t[1], F.col(c)) for t, c in ends if t[0] == "var"]
            return self._unify(pairs, columns)
        columns = []
        if s[0] == "var":
            columns.append((s[1], subject))
        else:
            g = g.where((F.col("s") == s[1]) & (F.col("s_kind") == "iri"))
        if p[0] == "var":
            columns.append((p[1], term("iri", F.col("p"))))
        else:
            g = g.where(F.col("p") == p[1])
        if o[0] == "var":
            columns.append((o[1], obj))
        elif o[0] == "iri":
            g = g.where((F.col("o") == o[1]) & (F.col("o_kind") == "iri"))
        else:
            g = g.where((F.col("o") == o[1]) & (F.col("o_kind") == "literal") & (data == o[2]) & (language == (o[3] or "")))
        return self._unify(g, columns)

    def _unify(self, df: DataFrame, columns: list) -> Sol:
        first: dict = {}
        for name, c in columns:
            if name in first:
                df = df.where(first[name] == c)
            else:
                first[name] = c
        return Sol(df.select(*[c.alias(n) for n, c in first.items()]), frozenset(first))

    def _constant(self, t: tuple) -> Column:
        return term("iri", F.lit(t[1])) if t[0] == "iri" else term("literal", F.lit(t[1]), t[2], t[3] or "")

    def pairs(self, p: tuple) -> DataFrame:
        """(a, b): the ends of a path."""
        if p[0] == "iri":
            return self.scan(("var", "a"), p, ("var", "b")).df
        kind, *of = p[1:]
        if kind == "inv":
            return self.pairs(of[0]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "seq":
            x, y = self.pairs(of[0]).select("a", F.col("b").alias("m")), self.pairs(of[1]).select(F.col("a").alias("m"), "b")
            return x.join(y, "m").select("a", "b")
        if kind == "alt":
            return self.pairs(of[0]).unionByName(self.pairs(of[1]))
        if kind == "not":
            every = self.scan(("var", "a"), ("var", "p"), ("var", "b")).df
            ahead = every.where(~F.col("p")["v"].isin(of[0])) if of[0] or not of[1] else None
            back = every.where(~F.col("p")["v"].isin(of[1])).select(F.col("b").alias("a"), F.col("a").alias("b")) if of[1] else None
            parts = [x.select("a", "b") for x in (ahead, back) if x is not None]
            return reduce(DataFrame.unionByName, parts)
        base = self.pairs(of[0])
        reach = base.distinct() if kind == "?" else closure(base)
        if kind == "+":
            return reach
        every = self.scan(("var", "a"), ("var", "p"), ("var", "b")).df
        nodes = every.select("a").unionByName(every.select(F.col("b").alias("a"))).distinct()
        return reach.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()

    def join(self, x: Sol, y: Sol, how: str = "inner", condition: tuple | None = None) -> Sol:
        shared = sorted(x.names & y.names)
        right = y.df.select(*[F.col(n).alias(f"r:{n}") for n in y.df.columns])
        tests, any_bound = [], []
        for n in shared:
            a, b = F.col(n), F.col(f"r:{n}")
            tests.append(a == b if n in x.bound and n in y.bound else (a == b) | a.isNull() | b.isNull())
            any_bound.append(a.isNotNull() & b.isNotNull())
        if how == "minus":
            if not shared:
                return x
            if not any(n in x.bound and n in y.bound for n in shared):
                tests.append(reduce(lambda p, q: p | q, any_bound))
        if condition is not None:
            view = lambda n: F.col(n) if n in x.names else F.col(f"r:{n}") if n in y.names else F.lit(None).cast(TERM)
            tests.append(self._value(view, condition).truth)
        on = reduce(lambda p, q: p & q, tests) if tests else None
        kind = {"minus": "left_anti", "semi": "left_semi", "anti": "left_anti", "left": "left", "inner": "inner"}[how]
        df = x.df.join(right, on, kind) if on is not None else (x.df.crossJoin(right) if kind == "inner" else x.df.join(right, F.lit(True), kind))
        if kind in ("left_semi", "left_anti"):
            return Sol(df, x.bound, x.free)
        out = [F.col(n) if n in x.bound or n not in y.names else F.coalesce(F.col(n), F.col(f"r:{n}")).alias(n) for n in x.df.columns]
        out += [F.col(f"r:{n}").alias(n) for n in y.df.columns if n not in x.names]
        bound = x.bound | y.bound if kind == "inner" else x.bound
        return Sol(df.select(*out), bound, (x.names | y.names) - bound)

    def p_join(self, a: tuple, b: tuple) -> Sol:
        return self.join(self.pattern(a), self.pattern(b))

    def p_optional(self, a: tuple, b: tuple) -> Sol:
        x = self.pattern(a)
        inner, condition = self._peel(b)
        return self.join(x, self.pattern(inner), "left", condition)

    def _peel(self, p: tuple) -> tuple[tuple, tuple | None]:
        """Filters at the top of a pattern, taken off so that they may see the other side's variables."""
        condition = None
        while p[0] == "filter" and not self._has_exists(p[2]):
            condition = p[2] if condition is None else ("and", p[2], condition)
            p = p[1]
        return p, condition

    def p_union(self, a: tuple, b: tuple) -> Sol:
        x, y = self.pattern(a), self.pattern(b)
        missing = lambda s, o: s.df.select("*", *[F.lit(None).cast(TERM).alias(n) for n in o.df.columns if n not in s.df.columns])
        bound = x.bound & y.bound
        return Sol(missing(x, y).unionByName(missing(y, x)), bound, (x.names | y.names) - bound)

    def p_minus(self, a: tuple, b: tuple) -> Sol:
        return self.join(self.pattern(a), self.pattern(b), "minus")

    def p_filter(self, a: tuple, e: tuple) -> Sol:
        return self.filter(self.pattern(a), e)

    def p_bind(self, a: tuple, name: str, e: tuple) -> Sol:
        sol = self.pattern(a)
        if name in sol.names:
            raise QueryError(f"?{name} is bound already")
        return self.extend(sol, name, e)

    def p_values(self, names: list, rows: list) -> Sol:
        data = [tuple(None if t is None else ("iri", t[1], "", "") if t[0] == "iri" else ("literal", t[1], t[2], t[3] or "") for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {TERM}" for n in names))
        bound = frozenset(n for i, n in enumerate(names) if all(row[i] is not None for row in rows))
        return Sol(df, bound, frozenset(names) - bound)

    def p_service(self, address: str, p: tuple, silent: bool) -> Sol:
        if self.allowed is not None and address not in self.allowed:
            raise QueryError(f"service {address} is not allowed")
        if address not in self.services:
            if silent:
                return self.p_unit()
            raise QueryError(f"no such service: {address}")
        return Engine(self.services[address], self.services, self.prefixes, self.allowed).pattern(p)

    def p_select(self, q: Query) -> Sol:
        return self.run(q)[1]

    # -- filters and extensions

    def _has_exists(self, e: object) -> bool:
        return isinstance(e, tuple | list) and bool(e) and (e[0] == "exists" or any(self._has_exists(x) for x in e))

    def _has_agg(self, e: object) -> bool:
        return isinstance(e, tuple | list) and bool(e) and (e[0] == "agg" or any(self._has_agg(x) for x in e))

    def filter(self, sol: Sol, e: tuple) -> Sol:
        if e[0] == "and":
            return self.filter(self.filter(sol, e[1]), e[2])
        if e[0] == "exists" or e[0] == "not" and e[1][0] == "exists":
            inner, condition = self._peel((e if e[0] == "exists" else e[1])[1])
            return self.join(sol, self.pattern(inner), "semi" if e[0] == "exists" else "anti", condition)
        marks: list[str] = []
        if self._has_exists(e):
            sol, e = self._marked(sol, e, marks)
        out = sol.df.where(self.value(sol, e).truth)
        return Sol(out.drop(*marks), sol.bound, sol.free)

    def _marked(self, sol: Sol, e: tuple, marks: list[str]) -> tuple[Sol, tuple]:
        """EXISTS inside an expression becomes a column that a left join on the distinct shared variables sets."""
        if e[0] == "exists":
            inner = self.pattern(e[1])
            shared = sorted(sol.names & inner.names)
            name = f"__mark{len(marks)}"
            marks.append(name)
            keys = inner.df.select(*[F.col(n).alias(f"r:{n}") for n in shared]).distinct().withColumn(name, F.lit(True))
            on = reduce(lambda p, q: p & q, [F.col(n) == F.col(f"r:{n}") for n in shared]) if shared else F.lit(True)
            df = sol.df.join(keys, on, "left").drop(*[f"r:{n}" for n in shared])
            return Sol(df, sol.bound, sol.free), ("mark", name)
        parts = []
        for x in e:
            if isinstance(x, tuple) and self._has_exists(x):
                sol, x = self._marked(sol, x, marks)
            parts.append(x)
        return sol, tuple(parts)

    def extend(self, sol: Sol, name: str, e: tuple) -> Sol:
        c = self.value(sol, e).as_term
        return Sol(sol.df.withColumn(name, c), sol.bound - {name}, sol.free | {name})

    # -- aggregation

    def aggregate(self, sol: Sol, q: Query, items: list) -> tuple[Sol, Callable]:
        keys, names = [], []
        for i, (name, e) in enumerate(q.group):
            names.append(name or f"__key{i}")
            keys.append(self.value(sol, e).as_term.alias(names[-1]))
        found: list[tuple] = []

        def swap(e: object) -> object:
            if isinstance(e, tuple) and e and e[0] == "agg":
                if e not in found:
                    found.append(e)
                return ("var", f"__agg{found.index(e)}")
            if isinstance(e, tuple):
                if e in [g for _, g in q.group] and e[0] != "var":
                    return ("var", names[[g for _, g in q.group].index(e)])
                return tuple(swap(x) for x in e)
            return [swap(x) for x in e] if isinstance(e, list) else e

        for e in [e for _, e in items if e] + q.having + [e for e, _ in q.order]:
            swap(e)
        columns = [self._aggregate(sol, a).alias(f"__agg{i}") for i, a in enumerate(found)]
        df = sol.df.groupBy(*keys).agg(*columns) if columns else sol.df.select(*keys).distinct()
        aggs = frozenset(f"__agg{i}" for i in range(len(found)))
        bound = frozenset(n for n, (_, e) in zip(names, q.group) if e[0] == "var" and e[1] in sol.bound)
        return Sol(df, bound, (frozenset(names) | aggs) - bound), swap

    def _aggregate(self, sol: Sol, a: tuple) -> Column:
        _, name, e, distinct, separator = a
        if e is None:
            c = F.count_distinct(F.struct(*[F.col(n) for n in sorted(sol.names)])) if distinct else F.count(F.lit(1))
            return Val("num", c.cast("double")).as_term
        v = self.value(sol, e)
        t = v.as_term
        if name == "COUNT":
            return Val("num", (F.count_distinct(t) if distinct else F.count(t)).cast("double")).as_term
        if name in ("SUM", "AVG"):
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda c: F.sum_distinct(c) / F.count_distinct(c)}[name, distinct]
            return Val("num", F.coalesce(f(v.num), F.lit(0.0))).as_term
        if name == "GROUP_CONCAT":
            gathered = F.collect_set(v.text) if distinct else F.collect_list(v.text)
            return Val("str", F.array_join(F.array_sort(gathered), separator)).as_term
        key = F.when(t.isNotNull(), F.struct(*_sort_keys(v)))
        return F.max_by(t, key) if name == "MAX" else F.min_by(t, key)  # any value will do for SAMPLE

    # -- expressions

    def value(self, sol: Sol, e: tuple) -> Val:
        return self._value(lambda n: F.col(n) if n in sol.names else F.lit(None).cast(TERM), e)

    def _value(self, view: Callable[[str], Column], e: tuple) -> Val:
        of = lambda x: self._value(view, x)
        kind = e[0]
        if kind == "var":
            return Val("term", view(e[1]))
        if kind == "mark":
            return Val("bool", F.coalesce(F.col(e[1]), F.lit(False)))
        if kind == "iri":
            return Val("term", self._constant(e))
        if kind == "lit":
            if e[2] in NUMERIC:
                return Val("num", F.lit(float(e[1])))
            if e[2] == XSD + "boolean":
                return Val("bool", F.lit(e[1] in ("true", "1")))
            return Val("str", F.lit(e[1])) if e[2] == XSD + "string" else Val("term", self._constant(e))
        if kind in ("and", "or"):
            a, b = of(e[1]).truth, of(e[2]).truth
            return Val("bool", a & b if kind == "and" else a | b)
        if kind == "not":
            return Val("bool", ~of(e[1]).truth)
        if kind == "cmp":
            return Val("bool", self._compare(e[1], of(e[2]), of(e[3])))
        if kind == "in":
            a = of(e[1])
            return Val("bool", reduce(lambda p, q: p | q, [self._compare("=", a, of(x)) for x in e[2]], F.lit(False)))
        if kind == "math":
            a, b = of(e[2]).num, of(e[3]).num
            return Val("num", {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[e[1]])
        if kind == "cast":
            return self._cast(e[1], of(e[2]))
        if kind == "call":
            return self._call(e[1], e[2], of, view)
        raise QueryError(f"can't evaluate {kind}")

    def _compare(self, op: str, a: Val, b: Val) -> Column:
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if a.t != "term" or b.t != "term":
            kinds = {a.t, b.t} - {"term"}
            if len(kinds) == 2:
                return F.lit(op == "!=") if op in ("=", "!=") else F.lit(None).cast("boolean")
            if kinds == {"num"}:
                return test(a.num, b.num)
            if kinds == {"bool"}:
                as_bool = lambda v: v.c if v.t == "bool" else F.when(v.c["d"] == XSD + "boolean", v.c["v"].isin("true", "1"))
                return test(as_bool(a), as_bool(b))
            if op in ("=", "!="):
                same = lambda v: v.c if v.t == "str" else F.when((v.c["k"] == "literal") & (v.c["d"] == XSD + "string"), v.c["v"])
                x, y = same(a), same(b)
                equal = F.coalesce(x == y, F.lit(False))
                known = a.c.isNotNull() & b.c.isNotNull()
                return F.when(known, equal if op == "=" else ~equal)
            plain = lambda v: v.c if v.t == "str" else F.when((v.c["k"] == "literal") & ~v.c["d"].isin(NUMERIC), v.c["v"])
            return test(plain(a), plain(b))
        both = a.num.isNotNull() & b.num.isNotNull()
        if op in ("=", "!="):
            return F.when(both, test(a.num, b.num)).otherwise(test(a.c, b.c))
        literals = (a.c["k"] == "literal") & (b.c["k"] == "literal") & a.num.isNull() & b.num.isNull()
        return F.when(both, test(a.num, b.num)).when(literals, test(a.c["v"], b.c["v"]))

    def _cast(self, to: str, v: Val) -> Val:
        name = to.removeprefix(XSD)
        if name in ("integer", "int", "long"):
            return Val("num", F.floor(v.text.try_cast("double")).cast("double"))
        if name in ("decimal", "double", "float"):
            return Val("num", v.text.try_cast("double"))
        if name == "boolean":
            return Val("bool", v.text.try_cast("boolean"))
        if name == "string":
            return Val("str", v.text)
        if name in ("dateTime", "date"):
            return Val("term", F.when(v.text.try_cast("timestamp").isNotNull(), term("literal", v.text, to)))
        raise QueryError(f"unknown function {to}")

    def _call(self, name: str, args: list, of: Callable, view: Callable) -> Val:
        if name == "BOUND":
            return Val("bool", view(args[0][1]).isNotNull())
        if name == "COALESCE":
            vals = [of(a) for a in args]
            kinds = {v.t for v in vals}
            return Val(kinds.pop(), F.coalesce(*[v.c for v in vals])) if len(kinds) == 1 else Val("term", F.coalesce(*[v.as_term for v in vals]))
        if name == "IF":
            c, a, b = of(args[0]).truth, of(args[1]), of(args[2])
            return Val(a.t, F.when(c, a.c).when(~c, b.c)) if a.t == b.t else Val("term", F.when(c, a.as_term).when(~c, b.as_term))
        v = [of(a) for a in args]
        s = [x.text for x in v]
        t = v[0].as_term if v else None
        when_term = lambda c: F.when(t.isNotNull(), c)
        flags = lambda i: self._flags(args[i]) if len(args) > i else ""
        table: dict[str, Callable[[], Val]] = {
            "STR": lambda: Val("str", s[0]),
            "LANG": lambda: Val("str", when_term(t["l"])),
            "LANGMATCHES": lambda: Val("bool", F.when(s[1] == "*", s[0] != "").otherwise((F.lower(s[0]) == F.lower(s[1])) | F.startswith(F.lower(s[0]), F.concat(F.lower(s[1]), F.lit("-"))))),
            "DATATYPE": lambda: Val("term", F.when(t["k"] == "literal", term("iri", t["d"]))),
            "IRI": lambda: Val("term", F.when(s[0].isNotNull(), term("iri", s[0]))),
            "BNODE": lambda: Val("term", term("blank", s[0] if s else F.expr("uuid()"))),
            "UUID": lambda: Val("term", term("iri", F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))),
            "STRUUID": lambda: Val("str", F.expr("uuid()")),
            "RAND": lambda: Val("num", F.rand()),
            "NOW": lambda: Val("term", term("literal", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")),
            "ABS": lambda: Val("num", F.abs(v[0].num)),
            "CEIL": lambda: Val("num", F.ceil(v[0].num).cast("double")),
            "FLOOR": lambda: Val("num", F.floor(v[0].num).cast("double")),
            "ROUND": lambda: Val("num", F.floor(v[0].num + 0.5).cast("double")),
            "CONCAT": lambda: Val("str", F.concat(*s) if s else F.lit("")),
            "STRLEN": lambda: Val("num", F.length(s[0]).cast("double")),
            "UCASE": lambda: Val("str", F.upper(s[0])),
            "LCASE": lambda: Val("str", F.lower(s[0])),
            "ENCODE_FOR_URI": lambda: Val("str", F.replace(F.url_encode(s[0]), F.lit("+"), F.lit("%20"))),
            "CONTAINS": lambda: Val("bool", F.contains(s[0], s[1])),
            "STRSTARTS": lambda: Val("bool", F.startswith(s[0], s[1])),
            "STRENDS": lambda: Val("bool", F.endswith(s[0], s[1])),
            "STRBEFORE": lambda: Val("str", F.when(F.instr(s[0], s[1]) > 0, F.substring(s[0], F.lit(1), F.instr(s[0], s[1]) - 1)).when(s[0].isNotNull(), "")),
            "STRAFTER": lambda: Val("str", F.when(F.instr(s[0], s[1]) > 0, F.substring(s[0], F.instr(s[0], s[1]) + F.length(s[1]), F.length(s[0]))).when(s[0].isNotNull(), "")),
            "SUBSTR": lambda: Val("str", F.substring(s[0], v[1].num.cast("int"), v[2].num.cast("int") if len(v) > 2 else F.length(s[0]))),
            "REPLACE": lambda: Val("str", F.regexp_replace(s[0], F.concat(F.lit(flags(3)), s[1]), s[2])),
            "REGEX": lambda: Val("bool", F.regexp_like(s[0], F.concat(F.lit(flags(2)), s[1]))),
            "SAMETERM": lambda: Val("bool", v[0].as_term == v[1].as_term),
            "ISIRI": lambda: Val("bool", when_term(t["k"] == "iri")),
            "ISBLANK": lambda: Val("bool", when_term(t["k"] == "blank")),
            "ISLITERAL": lambda: Val("bool", when_term(t["k"] == "literal")),
            "ISNUMERIC": lambda: Val("bool", when_term(v[0].num.isNotNull())),
            "STRDT": lambda: Val("term", term("literal", s[0], s[1])),
            "STRLANG": lambda: Val("term", term("literal", s[0], _LANG_STRING, F.lower(s[1]))),
            "MD5": lambda: Val("str", F.md5(s[0].cast("binary"))),
            "SHA1": lambda: Val("str", F.sha1(s[0].cast("binary"))),
            "SHA256": lambda: Val("str", F.sha2(s[0].cast("binary"), 256)),
            "SHA384": lambda: Val("str", F.sha2(s[0].cast("binary"), 384)),
            "SHA512": lambda: Val("str", F.sha2(s[0].cast("binary"), 512)),
            "TZ": lambda: Val("str", F.regexp_extract(s[0], r"(Z|[+-]\d{2}:\d{2})$", 1)),
        }
        table |= {"URI": table["IRI"], "ISURI": table["ISIRI"]}
        parts = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}
        if name in parts:
            return Val("num", parts[name](s[0].try_cast("timestamp")).cast("double"))
        if name not in table:
            raise QueryError(f"unknown function {name}")
        return table[name]()

    def _flags(self, e: tuple) -> str:
        if e[0] != "lit":
            raise QueryError("flags must be fixed")
        return f"(?{e[1]})" if e[1] else ""


def select(graph: DataFrame, text: str, limit: int | None = DEFAULT_LIMIT, **options: object) -> DataFrame:
    return Engine(graph, **options).select(text, limit)


def ask(graph: DataFrame, text: str, **options: object) -> DataFrame:
    return Engine(graph, **options).ask(text)
