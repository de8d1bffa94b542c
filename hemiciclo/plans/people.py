"""Queries over deputies, circles and parties.

Children of one parent are gated on the parent's existence by an EXISTS subquery: the parent is
looked up once, and no join puts all its children under one join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.operators.paging import Key, Listing, ascending
from hemiciclo.operators.predicates import (
    DEFAULT_LIMIT, contains_text, equals, holds, legislature_code, party_code, select_where,
)
from hemiciclo.plans.initiatives import AUTHOR_GROUPS, AUTHOR_MEMBERS, headers, recent_initiatives
from hemiciclo.plans.initiatives import LIST_COLUMNS as INITIATIVE_COLUMNS

DEPUTY_COLUMNS = [
    "legislatura", "dep_cad_id", "nome_parlamentar", "circulo_atual", "partido_atual", "situacao_atual",
]
ACTIVE = "Efetivo"  # Fixed value: status of a sitting deputy.


def _deputy_order():
    return ascending("nome_parlamentar", "legislatura", "dep_cad_id")


def list_deputies(
    deputies: DataFrame, *, legislatura: str | None = None, partido: str | None = None, circulo: str | None = None,
    situacao: str | None = None, q: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    rows = select_where(
        deputies, equals("legislatura", legislature_code(legislatura)), equals("partido_atual", party_code(partido)),
        equals("circulo_atual", circulo), equals("situacao_atual", situacao), contains_text("nome_parlamentar", q),
    )
    return Listing(rows, _deputy_order(), DEPUTY_COLUMNS, limit, offset)


def deputy(deputies: DataFrame, dep_cad_id: float, legislatura: str) -> DataFrame:
    return select_where(
        deputies, equals("dep_cad_id", float(dep_cad_id)), equals("legislatura", legislature_code(legislatura))
    ).limit(1)


def deputy_initiatives(
    deputies: DataFrame, initiatives: DataFrame, dep_cad_id: float | str, legislatura: str, *,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    """Initiatives a deputy signed. The order is by number as text, like the numbers themselves."""
    parent = deputy(deputies, float(dep_cad_id), legislatura)
    rows = select_where(
        headers(initiatives), equals("legislatura", legislature_code(legislatura)),
        holds(AUTHOR_MEMBERS, str(int(float(dep_cad_id)))),
    ).where(parent.exists())
    order = [Key("ini_nr", descending=True), Key("ini_id")]
    return Listing(rows, order, INITIATIVE_COLUMNS, limit, offset)


def list_circles(
    circles: DataFrame, *, legislatura: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0
) -> Listing:
    rows = select_where(circles, equals("legislatura", legislature_code(legislatura)))
    return Listing(rows, ascending("cp_des", "legislatura", "cp_id"), ["legislatura", "cp_id", "cp_des"], limit, offset)


def circle(circles: DataFrame, cp_id: float, legislatura: str) -> DataFrame:
    return select_where(
        circles, equals("cp_id", float(cp_id)), equals("legislatura", legislature_code(legislatura))
    ).limit(1)


def circle_deputies(
    circles: DataFrame, deputies: DataFrame, cp_id: float, legislatura: str, *,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    """The sitting deputies of a circle."""
    rows = select_where(
        deputies, equals("circulo_id", float(cp_id)), equals("legislatura", legislature_code(legislatura)),
        equals("situacao_atual", ACTIVE),
    ).where(circle(circles, cp_id, legislatura).exists())
    return Listing(rows, _deputy_order(), DEPUTY_COLUMNS, limit, offset)


def deputies_of_circles(circles: DataFrame, deputies: DataFrame) -> DataFrame:
    """Deputies of every circle of every legislature, whatever their status."""
    return children_of_known(deputies, circles, {"circulo_id": "cp_id", "legislatura": "legislatura"})


def sitting_deputies(circles: DataFrame, deputies: DataFrame) -> DataFrame:
    """What `circle_deputies` lists, for all circles at once."""
    return deputies_of_circles(circles, deputies.where(F.col("situacao_atual") == ACTIVE))


def list_parties(
    parties: DataFrame, *, legislatura: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0
) -> Listing:
    rows = select_where(parties, equals("legislatura", legislature_code(legislatura)))
    return Listing(rows, ascending("gp_sigla", "legislatura"), ["legislatura", "gp_sigla", "gp_nome"], limit, offset)


def party(parties: DataFrame, gp_sigla: str, legislatura: str) -> DataFrame:
    return select_where(
        parties, equals("gp_sigla", gp_sigla.upper()), equals("legislatura", legislature_code(legislatura))
    ).limit(1)


def party_deputies(
    parties: DataFrame, deputies: DataFrame, gp_sigla: str, legislatura: str, *,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    """Deputies whose current party this is, whatever their status."""
    rows = select_where(
        deputies, equals("partido_atual", gp_sigla.upper()), equals("legislatura", legislature_code(legislatura))
    ).where(party(parties, gp_sigla, legislatura).exists())
    return Listing(rows, _deputy_order(), DEPUTY_COLUMNS, limit, offset)


def party_initiatives(
    parties: DataFrame, initiatives: DataFrame, gp_sigla: str, legislatura: str, *,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> Listing:
    rows = select_where(
        headers(initiatives), equals("legislatura", legislature_code(legislatura)),
        holds(AUTHOR_GROUPS, gp_sigla.upper()),
    ).where(party(parties, gp_sigla, legislatura).exists())
    return Listing(rows, recent_initiatives(), INITIATIVE_COLUMNS, limit, offset)


def children_of_known(children: DataFrame, parents: DataFrame, on: dict[str, str]) -> DataFrame:
    """All children whose parent exists, for every parent at once; ``on`` maps child to parent column."""
    keys = parents.select(*[F.col(p).alias(f"_{c}") for c, p in on.items()])
    match = [children[c] == keys[f"_{c}"] for c in on]
    return children.join(keys, match, "left_semi")
