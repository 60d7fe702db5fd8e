"""SPARQL text to an algebra of plain tuples.

Terms: ("var", name), ("iri", text), ("lit", lexical, datatype, language). Patterns: ("bgp", triples), ("join", a, b),
("optional", a, b), ("union", a, b), ("minus", a, b), ("filter", a, expr), ("bind", a, var, expr), ("values", vars, rows),
("service", endpoint, pattern, silent), ("select", query), ("unit",). Paths: ("path", kind, ...). Updates, CONSTRUCT and DESCRIBE
are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from graphloom.operators.triples import PREFIXES, TYPE, XSD


class QueryError(ValueError):
    """A query that can't be read, or that isn't allowed."""


_LEX = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>[?$]\w+)
    |(?P<num>(?:\d+\.\d+|\.?\d+)(?:[eE][+-]?\d+)?)
    |(?P<blank>_:[\w.-]*\w)
    |(?P<name>(?:[A-Za-z_][\w.-]*)?:(?:[\w%](?:[\w.:%-]*[\w:%-])?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!*/+?^|-])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
UPDATES = {"INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD", "WITH", "CONSTRUCT", "DESCRIBE"}


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


@dataclass
class Query:
    form: str
    where: tuple
    items: list = field(default_factory=list)  # (name, expression or None); empty for *
    star: bool = False
    distinct: bool = False
    group: list = field(default_factory=list)  # (name or None, expression)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str]) -> None:
        self.prefixes, self.base, self.fresh = dict(prefixes), "", 0
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def is_op(self, *ops: str) -> bool:
        return self.peek()[0] == "op" and self.peek()[1] in ops

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in words

    def op(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.at += 1
            return True
        return False

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.op(text) or self.word(text)):
            raise QueryError(f"expected {text}, found {self.peek()[1]!r}")

    # -- terms

    def expand(self, name: str) -> str:
        head, _, local = name.partition(":")
        if head not in self.prefixes:
            raise QueryError(f"unknown prefix {head}:")
        return self.prefixes[head] + local

    def iri(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            return text[1:-1] if ":" in text or not self.base else self.base + text[1:-1]
        if kind == "name":
            return self.expand(text)
        raise QueryError(f"expected an IRI, found {text!r}")

    def blank(self, label: str = "") -> tuple:
        if not label:
            self.fresh += 1
            label = f"anon{self.fresh}"
        return ("var", f"__{label}")  # a blank node of a pattern is a variable that isn't returned

    def term(self) -> tuple:
        kind, text = self.peek()
        if kind == "var":
            self.at += 1
            return ("var", text[1:])
        if kind in ("iri", "name"):
            return ("iri", self.iri())
        if kind in ("str", "long"):
            self.at += 1
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.op("^^"):
                return ("lit", value, self.iri(), None)
            if self.peek()[0] == "lang":
                return ("lit", value, PREFIXES["rdf"] + "langString", self.take()[1][1:].lower())
            return ("lit", value, XSD + "string", None)
        if kind == "num" or self.is_op("-", "+") and self.peek(1)[0] == "num":
            sign = ""
            if kind == "op":
                sign = "-" if self.take()[1] == "-" else ""
            return number(sign + self.take()[1])
        if self.word("TRUE"):
            return ("lit", "true", XSD + "boolean", None)
        if self.word("FALSE"):
            return ("lit", "false", XSD + "boolean", None)
        if kind == "blank":
            self.at += 1
            return self.blank(text[2:])
        raise QueryError(f"expected a term, found {text!r}")

    # -- queries

    def query(self) -> Query:
        while self.is_word("PREFIX", "BASE"):
            if self.word("BASE"):
                self.base = self.iri()
            else:
                self.take()
                kind, name = self.take()
                if kind != "name" or not name.endswith(":"):
                    raise QueryError(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = self.iri()
        out = self.select() if self.is_word("SELECT") else self.ask()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return out

    def ask(self) -> Query:
        if self.is_word(*UPDATES):
            raise QueryError(f"only SELECT and ASK are allowed, not {self.peek()[1].upper()}")
        self.need("ASK")
        self.word("WHERE")
        return self.tail(Query("ask", self.group_pattern()))

    def select(self) -> Query:
        self.need("SELECT")
        q = Query("select", ("unit",))
        q.distinct = self.word("DISTINCT")
        self.word("REDUCED")
        if self.op("*"):
            q.star = True
        else:
            while self.peek()[0] == "var" or self.is_op("("):
                if self.op("("):
                    e = self.expression()
                    self.need("AS")
                    q.items.append((self.take()[1][1:], e))
                    self.need(")")
                else:
                    q.items.append((self.take()[1][1:], None))
            if not q.items:
                raise QueryError("SELECT needs variables")
        if self.is_word("FROM"):
            raise QueryError("FROM is not supported: there is one default graph")
        self.word("WHERE")
        q.where = self.group_pattern()
        return self.tail(q)

    def tail(self, q: Query) -> Query:
        if self.word("GROUP"):
            self.need("BY")
            while True:
                if self.op("("):
                    e, name = self.expression(), None
                    if self.word("AS"):
                        name = self.take()[1][1:]
                    self.need(")")
                    q.group.append((name, e))
                elif self.peek()[0] == "var":
                    v = self.take()[1][1:]
                    q.group.append((v, ("var", v)))
                elif self.peek()[0] == "word" and self.peek(1) == ("op", "(") and not self.is_word("HAVING", "ORDER"):
                    q.group.append((None, self.primary()))
                else:
                    break
        if self.word("HAVING"):
            while self.is_op("(") or self.peek()[0] == "word" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES"):
                q.having.append(self.primary())
        if self.word("ORDER"):
            self.need("BY")
            while True:
                if self.is_word("ASC", "DESC"):
                    down = self.take()[1].upper() == "DESC"
                    q.order.append((self.primary(), down))
                elif self.peek()[0] == "var" or self.is_op("(") or self.peek()[0] == "word" and not self.is_word("LIMIT", "OFFSET", "VALUES"):
                    q.order.append((self.primary(), False))
                else:
                    break
        while self.is_word("LIMIT", "OFFSET"):
            which = self.take()[1].upper()
            kind, n = self.take()
            if kind != "num" or not n.isdigit():
                raise QueryError(f"{which} needs a number")
            if which == "LIMIT":
                q.limit = int(n)
            else:
                q.offset = int(n)
        if self.is_word("VALUES"):
            q.where = ("join", q.where, self.values())
        return q

    # -- patterns

    def group_pattern(self) -> tuple:
        self.need("{")
        if self.is_word("SELECT"):
            q = self.select()
            self.need("}")
            return ("select", q)
        out, filters = ("unit",), []

        def join(p: tuple) -> tuple:
            return p if out == ("unit",) else ("join", out, p)

        while not self.op("}"):
            if self.peek()[0] == "end":
                raise QueryError("a pattern isn't closed")
            if self.word("FILTER"):
                filters.append(self.constraint())
            elif self.word("OPTIONAL"):
                out = ("optional", out, self.group_pattern())
            elif self.word("MINUS"):
                out = ("minus", out, self.group_pattern())
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out = ("bind", out, self.take()[1][1:], e)
                self.need(")")
            elif self.is_word("VALUES"):
                out = join(self.values())
            elif self.word("SERVICE"):
                silent = self.word("SILENT")
                if self.peek()[0] == "var":
                    raise QueryError("a service's address must be fixed")
                where = self.iri()
                out = join(("service", where, self.group_pattern(), silent))
            elif self.word("GRAPH"):
                raise QueryError("GRAPH is not supported: there is one default graph")
            elif self.is_op("{"):
                p = self.group_pattern()
                while self.word("UNION"):
                    p = ("union", p, self.group_pattern())
                out = join(p)
            elif self.op("."):
                continue
            else:
                out = join(("bgp", self.triples()))
        for f in filters:
            out = ("filter", out, f)
        return out

    def constraint(self) -> tuple:
        if self.word("NOT"):
            self.need("EXISTS")
            return ("not", ("exists", self.group_pattern()))
        if self.word("EXISTS"):
            return ("exists", self.group_pattern())
        return self.primary()

    def values(self) -> tuple:
        self.need("VALUES")
        if self.peek()[0] == "var":
            names, single = [self.take()[1][1:]], True
        else:
            self.need("(")
            names, single = [], False
            while not self.op(")"):
                names.append(self.take()[1][1:])
        self.need("{")
        rows = []
        while not self.op("}"):
            if not single:
                self.need("(")
            row = [None if self.word("UNDEF") else self.term() for _ in names]
            if not single:
                self.need(")")
            rows.append(row)
        return ("values", names, rows)

    def triples(self) -> list:
        out: list = []
        while True:
            if self.is_op("[", "("):
                s = self.node(out)
                if self.is_op(".", "}"):
                    if not self.op("."):
                        return out
                    continue
            else:
                s = self.term()
            self.properties(s, out)
            if not self.op("."):
                return out
            kind, text = self.peek()
            if kind in ("end",) or kind == "op" and text not in ("[", "(") or kind == "word" and text.upper() not in ("TRUE", "FALSE"):
                return out

    def properties(self, s: tuple, out: list) -> None:
        while True:
            path = ("var", self.take()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append((s, path, self.node(out)))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.is_op(".", "}", "]"):
                return

    def node(self, out: list) -> tuple:
        if self.op("["):
            b = self.blank()
            if not self.op("]"):
                self.properties(b, out)
                self.need("]")
            return b
        if self.op("("):
            rdf = PREFIXES["rdf"]
            head = last = None
            while not self.op(")"):
                cell = self.blank()
                out.append((cell, ("iri", rdf + "first"), self.node(out)))
                if last:
                    out.append((last, ("iri", rdf + "rest"), cell))
                head, last = head or cell, cell
            if last:
                out.append((last, ("iri", rdf + "rest"), ("iri", rdf + "nil")))
            return head or ("iri", rdf + "nil")
        return self.term()

    def path(self) -> tuple:
        p = self.path_sequence()
        while self.op("|"):
            p = ("path", "alt", p, self.path_sequence())
        return p

    def path_sequence(self) -> tuple:
        p = self.path_step()
        while self.op("/"):
            p = ("path", "seq", p, self.path_step())
        return p

    def path_step(self) -> tuple:
        if self.op("^"):
            return ("path", "inv", self.path_step())
        if self.op("!"):
            many, ahead, back = self.op("("), [], []
            while True:
                (back if self.op("^") else ahead).append(self.verb())
                if not (many and self.op("|")):
                    break
            if many:
                self.need(")")
            return ("path", "not", ahead, back)
        if self.op("("):
            p = self.path()
            self.need(")")
        else:
            p = ("iri", self.verb())
        if self.is_op("*", "+", "?"):
            p = ("path", self.take()[1], p)
        return p

    def verb(self) -> str:
        if self.peek() == ("word", "a"):
            self.at += 1
            return TYPE
        return self.iri()

    # -- expressions

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.op("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.relation()
        while self.op("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self) -> tuple:
        e = self.sum()
        if self.is_op("=", "!=", "<", ">", "<=", ">="):
            return ("cmp", self.take()[1], e, self.sum())
        negated = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.at += 1
        if self.word("IN"):
            found = ("in", e, self.arguments())
            return ("not", found) if negated else found
        return e

    def sum(self) -> tuple:
        e = self.product()
        while True:
            if self.is_op("+", "-"):
                e = ("math", self.take()[1], e, self.product())
            else:
                return e

    def product(self) -> tuple:
        e = self.unary()
        while self.is_op("*", "/"):
            e = ("math", self.take()[1], e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.op("!"):
            return ("not", self.unary())
        if self.is_op("-") and self.peek(1)[0] != "num":
            self.take()
            return ("math", "-", number("0"), self.unary())
        if self.is_op("+") and self.peek(1)[0] != "num":
            self.take()
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            self.op(",")
        return out

    def primary(self) -> tuple:
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        if self.is_word("NOT", "EXISTS"):
            return self.constraint()
        if self.peek()[0] == "word" and not self.is_word("TRUE", "FALSE"):
            name = self.take()[1].upper()
            if name in AGGREGATES:
                self.need("(")
                distinct = self.word("DISTINCT")
                e = None if self.op("*") else self.expression()
                separator = " "
                if self.op(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = self.term()[1]
                self.need(")")
                return ("agg", name, e, distinct, separator)
            return ("call", name, self.arguments())
        t = self.term()
        if t[0] == "iri" and self.is_op("("):
            return ("cast", t[1], self.arguments()[0])
        return t


def number(text: str) -> tuple:
    return ("lit", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None)


def parse(text: str, prefixes: dict[str, str] = PREFIXES) -> Query:
    return Parser(text, prefixes).query()
