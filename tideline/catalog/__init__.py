"""Registered analyses over the driver tables, each with its SQL counterpart where one can be written."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"tideline.catalog.{module}")


MODULES = ["kill_queries", "loudness_queries", "text_queries", "report_queries", "project_queries", "caption_queries", "classify_queries", "select_queries", "story_queries", "source_queries", "stream_queries", "chain_queries", "shooter_queries", "detail_queries", "sink_queries"]
