"""Imports the query modules, which register themselves."""

from __future__ import annotations

import importlib

MODULES = [
    "temporal_queries",
    "filter_queries",
    "stats_queries",
    "join_queries",
    "source_queries",
    "prepare_queries",
    "pair_queries",
    "stream_queries",
]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"fieldspark.plans.{name}")
