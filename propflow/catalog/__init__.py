"""Registered queries over the given tables, each next to its SQL equivalent."""

from __future__ import annotations

from propflow.catalog import access, context, curation, estimates, evaluation, sequences, storage, texts

GROUPS = (curation, evaluation, context, sequences, texts, estimates, storage, access)

QUERIES = {name: query for group in GROUPS for name, query in group.QUERIES.items()}
ORACLE = {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
