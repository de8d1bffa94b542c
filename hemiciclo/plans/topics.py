"""Queries over the topic codes of initiatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.operators.paging import Key, Listing
from hemiciclo.operators.predicates import (
    DEFAULT_LIMIT, contains_text, equals, holds, legislature_code, party_code, select_where,
)
from hemiciclo.plans.initiatives import AUTHOR_GROUPS, headers

COLUMNS = [
    "ini_id", "legislatura", "cap", "cap_label", "model_version", "ini_nr", "ini_tipo", "ini_desc_tipo", "ini_titulo",
]


def topics_with_initiative(topics: DataFrame, initiatives: DataFrame) -> DataFrame:
    """Topic rows with the header of their initiative; matched on the id alone, in any legislature."""
    heads = initiatives.select("ini_id", "ini_nr", "ini_tipo", "ini_desc_tipo", "ini_titulo", "ini_data")
    return topics.join(heads, "ini_id")


def list_topics(
    topics: DataFrame, initiatives: DataFrame, *, legislatura: str | None = None, cap: int | None = None,
    autor_gp: str | None = None, tipo: str | None = None, q: str | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    """Filters are set on their own side of the join, before it. An absent table of topics is an
    empty one (see the optional read) and gives an empty page."""
    coded = select_where(topics, equals("legislatura", legislature_code(legislatura)), equals("cap", cap))
    heads = select_where(
        headers(initiatives), equals("ini_tipo", tipo), holds(AUTHOR_GROUPS, party_code(autor_gp or None)),
        contains_text("ini_titulo", q),
    )
    order = [Key(c, descending=True) for c in ("legislatura", "ini_data", "ini_id")]
    return Listing(topics_with_initiative(coded, heads), order, COLUMNS, limit, offset)


def topic(topics: DataFrame, initiatives: DataFrame, ini_id: str) -> DataFrame:
    one = headers(initiatives).where(F.col("ini_id") == ini_id)
    return topics_with_initiative(topics.where(F.col("ini_id") == ini_id), one).select(*COLUMNS)
