"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = (
    "analysis_queries",
    "filter_queries",
    "profile_queries",
    "cleaning_queries",
    "text_queries",
    "chunk_queries",
    "vector_queries",
    "evidence_queries",
    "conversation_queries",
    "storage_queries",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"gristmill.plans.{name}")
