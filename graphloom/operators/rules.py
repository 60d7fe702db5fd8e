"""Rules ``{ body } => { head }`` over a graph, to a fixpoint. Bodies are basic graph patterns, compiled as queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triples import COLUMNS, PREFIXES, fixpoint, union


def _parsed(rule: str, prefixes: dict[str, str]) -> tuple[tuple, list]:
    from graphloom.sparql.parser import Parser, QueryError

    body, arrow, head = rule.partition("=>")
    if not arrow:
        raise QueryError("a rule needs =>")
    parts = [Parser(x.strip().removesuffix("."), prefixes).group_pattern() for x in (body, head)]
    if parts[1][0] != "bgp":
        raise QueryError("a rule's head must be triples")
    return parts[0], parts[1][1]


def compiled(rule: str, prefixes: dict[str, str] = PREFIXES) -> Callable[[DataFrame], DataFrame]:
    """A function from a graph to the triples of the rule's head."""
    body, head = _parsed(rule, prefixes)

    def run(g: DataFrame) -> DataFrame:
        from graphloom.sparql.compiler import Engine

        engine = Engine(g, prefixes=prefixes)
        sol = engine.pattern(body)
        of = lambda t: F.col(t[1]) if t[0] == "var" else engine._constant(t)
        blank = lambda c: F.when(c != "", c)
        out = []
        for s, p, o in head:
            s, p, o = of(s), of(p), of(o)
            out.append(sol.df.where(s.isNotNull() & o.isNotNull()).select(s["v"].alias("s"), s["k"].alias("s_kind"), p["v"].alias("p"), o["v"].alias("o"), o["k"].alias("o_kind"), blank(o["d"]).alias("o_dt"), blank(o["l"]).alias("o_lang")))
        return union(*out).select(*COLUMNS)

    return run


def apply(g: DataFrame, rules: Sequence[str], prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """``g`` with all that the rules derive, again and again until nothing is new."""
    return fixpoint(g, [compiled(r, prefixes) for r in rules])
