"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with SQL over the same tables if it can be written."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Import every module that registers queries."""
    from . import file_queries, geometry_queries, image_queries, join_queries, lifecycle_queries, scene_queries, schedule_queries, stream_queries, trajectory_queries  # noqa: F401
