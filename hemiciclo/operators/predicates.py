"""Optional filters as Columns, and checks of query arguments.

Every builder gives None when its value is None: no value, no predicate. `select_where` joins what
is left with AND, so the whole condition reaches Catalyst as one expression and what can be pushed
into the Parquet scan is.
"""

from __future__ import annotations

import re
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEGISLATURE_PATTERN = r"^L[0-9]{1,3}$"
# Wider than letters and digits only: real codes hold a hyphen (CDS-PP) or one letter (L).
PARTY_PATTERN = r"^[A-Z0-9]{1,10}(-[A-Z0-9]{1,10})?$"
DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET = 50, 500, 100_000  # Fixed values: page bounds.


def _column(field: str | Column) -> Column:
    return F.col(field) if isinstance(field, str) else field


def equals(field: str | Column, value) -> Column | None:
    return None if value is None else _column(field) == F.lit(value)


def at_least(field: str | Column, value: date | None) -> Column | None:
    return None if value is None else _column(field) >= F.lit(value)


def at_most(field: str | Column, value: date | None) -> Column | None:
    return None if value is None else _column(field) <= F.lit(value)


def holds(items: str | Column, value) -> Column | None:
    """List membership; a NULL list holds nothing. ``xs.GP`` reads one field of a list of structs."""
    return None if value is None else F.array_contains(_column(items), F.lit(value))


def contains_text(field: str | Column, text: str | None) -> Column | None:
    """Case-insensitive substring. Blank text is no predicate; % and _ stay wildcards."""
    if text is None or not text.strip():
        return None
    # Spark's LIKE escapes with a backslash, which the search text has to mean literally.
    return _column(field).ilike("%" + text.strip().replace("\\", "\\\\") + "%")


def one_of(field: str | Column, values: list[str] | None) -> Column | None:
    return None if not values else _column(field).isin(values)


def comma_list(text: str | None) -> list[str] | None:
    """'Entrada, Admissão' -> ['Entrada', 'Admissão']; blanks drop out, nothing left is None."""
    items = [item.strip() for item in (text or "").split(",")]
    return [item for item in items if item] or None


def all_of(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else None


def select_where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    condition = all_of(*conditions)
    return df if condition is None else df.where(condition)


def legislature_code(value: str | None) -> str | None:
    return _code(value, LEGISLATURE_PATTERN, "legislature")


def party_code(value: str | None) -> str | None:
    return _code(value, PARTY_PATTERN, "party")


def _code(value: str | None, pattern: str, what: str) -> str | None:
    if value is None:
        return None
    if not re.fullmatch(pattern, value.upper()):
        raise ValueError(f"not a {what} code: {value!r}")
    return value.upper()


def page_bounds(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}, not {limit}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be 0 to {MAX_OFFSET}, not {offset}")
    return limit, offset


def normalize_codes(df: DataFrame, field: str, pattern: str, valid: str = "code_valid") -> DataFrame:
    """Upper-case a code column and flag the rows whose code doesn't fit the pattern as a whole."""
    pattern = pattern.removesuffix("$") + r"\z"  # a dollar would let a line end pass
    return df.withColumn(field, F.upper(field)).withColumn(valid, F.coalesce(F.col(field).rlike(pattern), F.lit(False)))
