"""All registered queries and their SQL statements."""

from __future__ import annotations

from importlib import import_module

from rootscope.session import use_utc

FAMILIES = ["traces", "spans", "metrics", "logs", "graph", "scoring", "cube", "sources", "plans"]


def _modules():
    return [import_module(f"rootscope.queries.{name}") for name in FAMILIES]


def _in_utc(query):
    def run(spark, sf_dir):
        use_utc(spark)
        return query(spark, sf_dir)

    return run


def all_queries() -> dict:
    return {key: _in_utc(query) for m in _modules() for key, query in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {key: sql for m in _modules() for key, sql in m.ORACLE.items()}
