"""Queries over activities and the votes on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.columns import has_items
from hemiciclo.operators.paging import Key, Listing, newest_first
from hemiciclo.operators.predicates import (
    DEFAULT_LIMIT, at_least, at_most, contains_text, equals, holds, legislature_code, party_code, select_where,
)
from hemiciclo.plans.votes import party_filters

ACTIVITY_COLUMNS = [
    "ativ_id", "legislatura", "ativ_tipo", "ativ_desc_tipo", "ativ_numero", "ativ_assunto", "data_entrada",
    "ativ_autores_gp",
]
VOTE_COLUMNS = [
    "vot_id", "ativ_id", "legislatura", "assunto", "tipo", "data", "resultado", "has_party_details",
]


def list_activities(
    activities: DataFrame, *, legislatura: str | None = None, tipo: str | None = None, autor_gp: str | None = None,
    data_desde: date | None = None, data_ate: date | None = None, q: str | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    rows = select_where(
        activities, equals("legislatura", legislature_code(legislatura)), equals("ativ_tipo", tipo),
        at_least("data_entrada", data_desde), at_most("data_entrada", data_ate),
        holds("ativ_autores_gp", party_code(autor_gp)), contains_text("ativ_assunto", q),
    )
    columns = [*ACTIVITY_COLUMNS, has_items("votacao_debate.id").alias("has_votes")]
    return Listing(rows, newest_first("data_entrada", Key("ativ_id")), columns, limit, offset)


def activity(activities: DataFrame, ativ_id: str) -> DataFrame:
    return activities.where(F.col("ativ_id") == ativ_id).drop("etl_timestamp").limit(1)


def list_activity_votes(
    votes: DataFrame, *, legislatura: str | None = None, ativ_id: str | None = None, tipo: str | None = None,
    resultado: str | None = None, q: str | None = None, data_desde: date | None = None,
    data_ate: date | None = None, partido_favor: str | None = None, partido_contra: str | None = None,
    partido_abstencao: str | None = None, has_party_details: bool | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    rows = select_where(
        votes, equals("legislatura", legislature_code(legislatura)), equals("ativ_id", ativ_id), equals("tipo", tipo),
        equals("resultado", resultado), equals("has_party_details", has_party_details),
        at_least("data", data_desde), at_most("data", data_ate),
        *party_filters(partido_favor, partido_contra, partido_abstencao), contains_text("assunto", q),
    )
    return Listing(rows, newest_first("data", Key("vot_id")), VOTE_COLUMNS, limit, offset)


def activity_vote(votes: DataFrame, vot_id: str) -> DataFrame:
    return votes.where(F.col("vot_id") == vot_id).limit(1)
