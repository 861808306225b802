"""Queries on the shipped tables; importing this package registers them all."""

from entitymill.queries import aggregates, features, modelling, scalars  # noqa: F401
from entitymill.queries.base import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
