"""Driver-facing queries, one module per section of the operator inventory."""

from __future__ import annotations

import importlib

from plazalens.catalog import registry

SECTIONS = ["maintain", "views", "reports", "threads", "claims", "labels", "evidence", "ingest"]


def _load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"plazalens.catalog.{section}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)
