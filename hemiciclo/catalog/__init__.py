"""All named queries, over the given tables shaped into parliamentary data."""

from hemiciclo.catalog import operator_entries, query_entries, storage_entries  # noqa: F401
from hemiciclo.catalog.registry import EXPECTED, QUERIES  # noqa: F401
