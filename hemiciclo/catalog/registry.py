"""Named queries and, for each that SQL can express, the statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.catalog.truth import with_truth
from hemiciclo.catalog.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def entry(name: str, expected: str | None = None):
    """Register a function of a workspace under ``name``."""
    def register(build: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
        if expected is not None:
            EXPECTED[name] = with_truth(expected)
        return build
    return register


def joined(items):
    """A list as one comparable text."""
    return F.array_join(F.sort_array(items), "|")


def big(column):
    return column.cast("bigint")


def rows():
    return F.count(F.lit(1))
