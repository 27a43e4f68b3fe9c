"""Registered queries of the core operators, and their SQL."""

from __future__ import annotations

from .plans import pipelines, vector_store

QUERIES = {**vector_store.QUERIES, **pipelines.QUERIES}
SQL = {**vector_store.SQL, **pipelines.SQL}
