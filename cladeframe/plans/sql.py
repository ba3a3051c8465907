"""All SQL of the matrix and tree queries."""

from __future__ import annotations

from . import catalogue_sql, oracles

SQL = dict(oracles.SQL) | catalogue_sql.SQL
