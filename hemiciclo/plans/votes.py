"""Queries over the votes on initiatives."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.operators.paging import Key, Listing, newest_first
from hemiciclo.operators.predicates import (
    DEFAULT_LIMIT, at_least, at_most, contains_text, equals, holds, legislature_code, party_code, select_where,
)

LIST_COLUMNS = ["vot_id", "ini_nr", "legislatura", "ini_titulo", "fase", "data", "resultado"]


def party_filters(favor: str | None, contra: str | None, abstencao: str | None) -> list[Column | None]:
    return [
        holds("detalhe_parsed.a_favor", party_code(favor)),
        holds("detalhe_parsed.contra", party_code(contra)),
        holds("detalhe_parsed.abstencao", party_code(abstencao)),
    ]


def list_votes(
    votes: DataFrame, *, legislatura: str | None = None, ini_id: str | None = None, resultado: str | None = None,
    q: str | None = None, data_desde: date | None = None, data_ate: date | None = None,
    partido_favor: str | None = None, partido_contra: str | None = None, partido_abstencao: str | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    rows = select_where(
        votes, equals("legislatura", legislature_code(legislatura)), equals("ini_id", ini_id),
        equals("resultado", resultado), at_least("data", data_desde), at_most("data", data_ate),
        *party_filters(partido_favor, partido_contra, partido_abstencao), contains_text("ini_titulo", q),
    )
    return Listing(rows, newest_first("data", Key("vot_id", descending=True)), LIST_COLUMNS, limit, offset)


def vote(votes: DataFrame, vot_id: str) -> DataFrame:
    return votes.where(F.col("vot_id") == vot_id).drop("ini_autores_gp").limit(1)
