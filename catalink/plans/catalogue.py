"""Imports every query module and hands out the registry."""

from __future__ import annotations

import importlib

from catalink.plans import registry

MODULES = ("text_queries", "link_queries", "record_queries", "learn_queries", "stream_queries",
           "job_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"catalink.plans.{name}")


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
