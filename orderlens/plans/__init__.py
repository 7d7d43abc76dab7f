"""Registered queries over the driver tables and the SQL each one is checked against."""

from .oracles import oracle_sql
from .data_queries import queries

__all__ = ["oracle_sql", "queries"]
