"""Registered queries over the domain tables."""

from . import aggregates, cards, changes, continuity, filters_joins, graph_facts, lanes, memory, records, retrieval, reviews, scalars, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "cards", "changes", "continuity", "filters_joins", "graph_facts", "lanes", "memory", "records", "retrieval", "reviews", "scalars", "streams"]
