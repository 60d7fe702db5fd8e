"""Operator catalogue: query name -> plan, and query name -> equivalent SQL."""

from graphloom.plans import documents, graphs, notes, ranking, streams
from graphloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "graphs", "notes", "ranking", "streams"]
