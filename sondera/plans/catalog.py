"""All queries of the retrieval engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import assembly, claims, corpora, linestreams, more, planning, retrieval, stores, structured, vectors, versions
from .registry import QUERIES, SQL
from .retrieval import flagship

__all__ = ["QUERIES", "SQL", "assembly", "claims", "corpora", "flagship", "linestreams", "more", "planning", "retrieval", "stores", "structured", "vectors", "versions"]
