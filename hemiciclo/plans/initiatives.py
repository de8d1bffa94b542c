"""Queries over initiatives and their events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.columns import picked
from hemiciclo.operators.paging import Key, Listing, ascending, newest_first
from hemiciclo.operators.predicates import (
    DEFAULT_LIMIT, all_of, at_least, at_most, comma_list, contains_text, equals, holds, legislature_code, one_of,
    party_code, select_where,
)

LIST_COLUMNS = ["ini_id", "ini_nr", "legislatura", "ini_tipo", "ini_desc_tipo", "ini_titulo"]
AUTHOR_GROUPS = "ini_autor_grupos_parlamentares.GP"
AUTHOR_MEMBERS = "ini_autor_deputados.idCadastro"

_EVENT_COLUMNS = {
    "EvtId": "evt_id", "OevId": "oev_id", "Fase": "fase", "CodigoFase": "codigo_fase", "DataFase": "data_fase",
    "ObsFase": "obs_fase", "Votacao": "votacao", "Comissao": "comissao", "AnexosFase": "anexos_fase",
    "Links": "links", "ActId": "act_id", "ActividadesConjuntas": "atividades_conjuntas",
    "IniciativasConjuntas": "iniciativas_conjuntas",
}


def headers(initiatives: DataFrame) -> DataFrame:
    """One row an initiative: further parts of a long one only add events."""
    return initiatives.where(F.col("parte") == 0)


def recent_initiatives() -> list[Key]:
    return newest_first("ini_data", Key("ini_id", descending=True))


def _event_condition(day: Column, phase: Column, since, until, phases) -> Column | None:
    return all_of(at_least(day, since), at_most(day, until), one_of(phase, phases))


def with_matching_event(
    initiatives: DataFrame, since: date | None = None, until: date | None = None, phases: list[str] | None = None
) -> DataFrame:
    """Headers of the initiatives with one event that meets all conditions at once.

    The test runs on each row's own event list, so nothing is shuffled, and reads no more than the
    two fields. Initiatives in several parts lie in files of their own: only those are read again,
    to find which of them have the event in any part.
    """
    found = F.exists(picked("ini_eventos", "Fase", "DataFase"), lambda e: _event_condition(e["DataFase"], e["Fase"], since, until, phases))
    found = F.coalesce(found, F.lit(False))
    # Rows that aren't read from the table tell by the number of their parts.
    stored = "longa" in initiatives.columns
    several, whole = (F.col("longa") == 1, F.col("longa") == 0) if stored else (F.col("partes") > 1, F.col("partes") == 1)
    long_ones = initiatives.where(several)
    matched = long_ones.where(found).select("legislatura", "ini_id").distinct()
    return initiatives.where(whole & found).unionByName(headers(long_ones).join(matched, ["legislatura", "ini_id"], "left_semi").select(initiatives.columns))


def list_initiatives(
    initiatives: DataFrame, *, legislatura: str | None = None, ini_nr: str | None = None, tipo: str | None = None,
    q: str | None = None, data_desde: date | None = None, data_ate: date | None = None,
    evento_fase: str | None = None, autor_gp: str | None = None, autor_tipo: str | None = None,
    dep_cad_id: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    base = select_where(
        initiatives, equals("legislatura", legislature_code(legislatura)), equals("ini_nr", ini_nr),
        equals("ini_tipo", tipo), holds(AUTHOR_GROUPS, party_code(autor_gp or None)),
        equals("ini_autor_outros.nome", autor_tipo or None), holds(AUTHOR_MEMBERS, dep_cad_id or None),
        contains_text("ini_titulo", q),
    )
    phases = comma_list(evento_fase)
    if data_desde or data_ate or phases:
        rows = with_matching_event(base, data_desde, data_ate, phases)
    else:
        rows = headers(base)
    columns = [*LIST_COLUMNS, F.col(AUTHOR_GROUPS).alias("autor_gp")]
    return Listing(rows, recent_initiatives(), columns, limit, offset)


def initiative(initiatives: DataFrame, ini_id: str) -> DataFrame:
    """The full nested record, a row a part, each with the first day of all its events; no row if there is none."""
    parts = initiatives.where(F.col("ini_id") == ini_id)
    first = parts.groupBy("ini_id").agg(F.min("ini_data").alias("ini_data"))  # one row
    return parts.drop("ini_data").join(F.broadcast(first), "ini_id").select(initiatives.columns)


def events(initiatives: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row an event, with what identifies its initiative; all event columns or those named."""
    head = ["ini_id", "ini_nr", "legislatura", "ini_titulo", "ini_tipo"]
    names = {old: new for old, new in _EVENT_COLUMNS.items() if columns is None or new in columns}
    items = "ini_eventos" if columns is None else picked("ini_eventos", *names)
    exploded = initiatives.select(*head, F.explode(items).alias("e"))
    return exploded.select(*head, *[F.col(f"e.{old}").alias(new) for old, new in names.items()])


def list_events(
    initiatives: DataFrame, ini_id: str, *, evento_fase: str | None = None, data_desde: date | None = None,
    data_ate: date | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    """Events of one initiative, oldest first. An unknown id has none; `initiative` tells it apart."""
    rows = events(initiatives.where(F.col("ini_id") == ini_id))
    rows = select_where(
        rows, at_least("data_fase", data_desde), at_most("data_fase", data_ate), one_of("fase", comma_list(evento_fase))
    )
    return Listing(rows, ascending("data_fase", "evt_id"), rows.columns, limit, offset)
