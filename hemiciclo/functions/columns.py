"""Small column expressions shared by the jobs and the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.schemas import INITIATIVE_NAMES

NOMINAL_LENGTH = 1000  # Fixed value: characters from which a vote record lists single members.


def rename_to(names: dict[str, str]) -> list[Column]:
    return [F.col(old).alias(new) for old, new in names.items()]


def normalize_columns(df: DataFrame, names: dict[str, str] = INITIATIVE_NAMES) -> DataFrame:
    """Rename every column: the mapped name where there is one, else lower case."""
    return df.withColumnsRenamed({c: names.get(c, c.lower()) for c in df.columns})


def last_of(items: str | Column) -> Column:
    """The current entry of a history list: its last element, NULL if the list is empty or NULL."""
    return F.try_element_at(F.col(items) if isinstance(items, str) else items, F.lit(-1))


def as_structs(items: str, names: dict[str, str]) -> Column:
    """A list of structs rebuilt with renamed fields."""
    return F.transform(items, lambda x: F.struct(*[x[old].alias(new) for old, new in names.items()]))


def picked(items: str, *fields: str) -> Column:
    """A list of structs with only these fields. Spark prunes a scan through the zip of single
    fields, but neither through an explode of several nor through a lambda on the whole struct."""
    return F.arrays_zip(*[F.col(f"{items}.{f}") for f in fields])


def non_empty(value: Column, size: Column) -> Column:
    return F.coalesce(value.isNotNull() & (size > 0), F.lit(False))


def has_items(items: str) -> Column:
    return non_empty(F.col(items), F.array_size(items))


def has_text(text: str) -> Column:
    return non_empty(F.col(text), F.length(text))


def first_date(items: str, field: str) -> Column:
    """Earliest date in a list of structs; NULLs don't count, an empty list gives NULL."""
    return F.array_min(F.col(f"{items}.{field}"))


def is_nominal(detail: Column) -> Column:
    return F.length(F.coalesce(detail, F.lit(""))) >= NOMINAL_LENGTH


def activity_key(legislature: Column, kind: Column, number: Column, subject: Column, entered: Column) -> Column:
    """``L17_VOT_12`` where the activity has a number, else the legislature and a text digest."""
    digest = F.md5(F.concat(
        F.coalesce(subject, F.lit("")), F.coalesce(entered.cast("string"), F.lit(""))
    ))
    return F.when(number.isNotNull(), F.concat(legislature, F.lit("_"), kind, F.lit("_"), number)).otherwise(
        F.concat(legislature, F.lit("_"), digest)
    )


def member_id_text(number: Column) -> Column:
    """A deputy id held as a double, in the text form that author lists use: 1234.0 -> '1234'."""
    return number.cast("bigint").cast("string")
