"""Read-only SPARQL 1.1, compiled to DataFrame plans."""

from .compiler import Engine, ask, select
from .parser import QueryError, parse

__all__ = ["Engine", "QueryError", "ask", "parse", "select"]
