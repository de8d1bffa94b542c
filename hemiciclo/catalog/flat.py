"""Whole records laid out flat, every field a column or a text, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.catalog.registry import joined
from hemiciclo.plans.initiatives import AUTHOR_GROUPS
from hemiciclo.schemas import POSITIONS


def listed(items: str | Column) -> Column:
    """A list as text in its own order."""
    return F.array_join(items, "|")


def some(items: str | Column) -> Column:
    """A list as sorted text; an empty one and none at all look alike."""
    column = F.col(items) if isinstance(items, str) else items
    return F.when(F.array_size(column) > 0, joined(column))


def vote_text(votes: str, *more: str) -> Column:
    """The votes of a list with all their fields."""
    fields = ("id", "data", "resultado", "descricao", "reuniao", *more, "unanime")
    return listed(F.transform(votes, lambda v: F.concat_ws(";", *[v[f].cast("string") for f in fields], listed(v["ausencias"]), v["detalhe"])))


_PLAIN = (
    "ini_id, ini_nr, legislatura, ini_tipo, ini_desc_tipo, ini_leg, ini_sel, ini_titulo, ini_texto_subst, ini_link_texto, ini_epigrafe, "
    "ini_obs, ini_texto_subst_campo, data_inicio_leg, data_fim_leg, iniciativas_europeias, links, propostas_alteracao"
).split(", ")
_LISTS = ["ini_anexos", "iniciativas_origem", "iniciativas_originadas", "peticoes"]


def initiative_columns() -> list[str | Column]:
    """All columns of an initiative but its events."""
    signers = F.transform("ini_autor_deputados", lambda d: F.concat_ws(":", d["idCadastro"], d["nome"]))
    return [
        *_PLAIN, *[listed(c).alias(c) for c in _LISTS], F.col("ini_autor_outros.sigla").alias("autor_sigla"),
        F.col("ini_autor_outros.nome").alias("autor_tipo"), listed(signers).alias("autores_deputados"), some(AUTHOR_GROUPS).alias("autor_gp"),
    ]


_INITIATIVE = ", ".join(f"ini.{c}" for c in [*_PLAIN, *_LISTS, "autor_sigla", "autor_tipo"]) + ", autores_deputados, autor_gp"
_WITH_AUTHORS = """ini LEFT JOIN signers ON signers.o_orderkey = ini.o_orderkey
    LEFT JOIN authors ON authors.o_orderkey = ini.o_orderkey"""
INITIATIVE_SQL = f"SELECT {_INITIATIVE}, ini_data, n_events FROM {_WITH_AUTHORS}"

_EVENT = "evt_id, oev_id, fase, codigo_fase, data_fase, obs_fase, comissao, links_fase, act_id".split(", ")
_EVENT_LISTS = ["anexos_fase", "atividades_conjuntas", "iniciativas_conjuntas"]


def event_columns(links: str = "links") -> list[str | Column]:
    """All columns of an event as `events` gives them."""
    return [
        *[F.col(links).alias(c) if c == "links_fase" else c for c in _EVENT], *[listed(c).alias(c) for c in _EVENT_LISTS],
        vote_text("votacao", "tipoReuniao").alias("votacao"),
    ]


_VOTE_TEXT = "concat_ws(';', vot.vot_id, vot.data, resultado, descricao, reuniao, tipo_reuniao, unanime, ausencias, detalhe)"
#: What an event's list of votes looks like: one vote, none, or no list.
EVENT_SQL = f"""
    SELECT {", ".join(f"evt.{c}" for c in [*_EVENT, *_EVENT_LISTS])}, evt.l_orderkey,
      CASE WHEN evt.l_returnflag <> 'N' THEN {_VOTE_TEXT}
        WHEN evt.l_linenumber % 2 = 0 THEN '' END AS votacao
    FROM evt LEFT JOIN vot ON vot.vot_id = evt.evt_id || '-v' LEFT JOIN vot_text ON vot_text.vot_id = vot.vot_id"""
INITIATIVE_RECORD_SQL = f"""
    SELECT {_INITIATIVE}, ini.ini_data, e.* EXCLUDE (l_orderkey) FROM {_WITH_AUTHORS} LEFT JOIN ({EVENT_SQL}) e ON e.l_orderkey = ini.o_orderkey"""


def initiative_record(record: DataFrame) -> DataFrame:
    """A nested record with its events laid out."""
    e = {"EvtId": "evt_id", "OevId": "oev_id", "Fase": "fase", "CodigoFase": "codigo_fase", "DataFase": "data_fase", "ObsFase": "obs_fase",
         "Comissao": "comissao", "Links": "_links", "ActId": "act_id", "AnexosFase": "anexos_fase", "ActividadesConjuntas": "atividades_conjuntas",
         "IniciativasConjuntas": "iniciativas_conjuntas", "Votacao": "votacao"}
    laid = record.select(*initiative_columns(), "ini_data", F.explode_outer("ini_eventos").alias("_e"))
    laid = laid.select("*", *[F.col(f"_e.{old}").alias(new) for old, new in e.items()]).drop("_e")
    kept = [c for c in laid.columns if c not in e.values()]
    return laid.select(*kept, *event_columns("_links"))


def parsed_lists() -> list[Column]:
    return [some(F.col(f"detalhe_parsed.{p}")).alias(p) for p in POSITIONS]


def vote_columns() -> list[str | Column]:
    """All columns of a vote on an initiative."""
    return [
        "vot_id", "ini_id", "ini_nr", "legislatura", "ini_titulo", "ini_tipo", "fase", "data_fase", "data", "resultado", "descricao", "reuniao",
        "tipo_reuniao", "unanime", listed("ausencias").alias("ausencias"), "detalhe", "is_nominal", *parsed_lists(),
    ]


VOTE_SQL = """
    SELECT vot.vot_id, ini_id, ini_nr, legislatura, ini_titulo, ini_tipo, fase, data_fase, data, resultado, descricao, reuniao, tipo_reuniao,
      unanime, ausencias, detalhe, is_nominal, a_favor, contra, abstencao, ausencia
    FROM vot LEFT JOIN vot_text ON vot_text.vot_id = vot.vot_id LEFT JOIN vot_lists ON vot_lists.vot_id = vot.vot_id"""

_ACTIVITY = {
    "ativ_assunto": "assunto", "ativ_tipo": "tipo", "ativ_desc_tipo": "desc_tipo", "ativ_numero": "numero", "sessao": "sessao",
    "data_entrada": "data_entrada", "data_agendamento_debate": "data_agendamento_debate", "data_anuncio": "data_anuncio",
    "ativ_tipo_autor": "tipo_autor", "observacoes": "observacoes",
}
_ACTIVITY_LISTS = ["publicacao", "publicacao_debate"]


def activity_columns() -> list[str | Column]:
    """All columns of an activity but its key."""
    return [
        *_ACTIVITY, *[listed(c).alias(c) for c in _ACTIVITY_LISTS], some("ativ_autores_gp").alias("ativ_autores_gp"),
        vote_text("votacao_debate").alias("votacao_debate"),
    ]


ACTIVITY_SQL = f"""
    SELECT act.ativ_id, act.legislatura, {", ".join(f"act.{sql} AS {name}" for name, sql in _ACTIVITY.items())},
      {", ".join(f"act.{c}" for c in _ACTIVITY_LISTS)}, autores_gp AS ativ_autores_gp,
      CASE WHEN has_votes THEN concat_ws(';', avot.vot_id, avot.data, resultado, descricao, reuniao, unanime, ausencias, detalhe)
        WHEN act.event_id % 2 = 0 THEN '' END AS votacao_debate
    FROM act LEFT JOIN act_authors ON act_authors.event_id = act.event_id LEFT JOIN avot ON avot.event_id = act.event_id
    LEFT JOIN avot_text ON avot_text.vot_id = avot.vot_id"""


def activity_vote_columns() -> list[str | Column]:
    """All columns of a vote on an activity."""
    return [
        "vot_id", "ativ_id", "legislatura", "assunto", "tipo", "numero", "data_entrada", some("autores_gp").alias("autores_gp"), "data", "resultado",
        "descricao", "reuniao", "unanime", listed("ausencias").alias("ausencias"), "detalhe", "has_party_details", "source",
        *parsed_lists()[:3],
    ]


ACTIVITY_VOTE_SQL = """
    SELECT avot.vot_id, ativ_id, legislatura, assunto, tipo, numero, data_entrada, autores_gp, data, resultado, descricao, reuniao, unanime,
      ausencias, detalhe, has_party_details, 'atividade' AS source, a_favor, contra, abstencao
    FROM avot LEFT JOIN act_authors ON act_authors.event_id = avot.event_id LEFT JOIN avot_text ON avot_text.vot_id = avot.vot_id"""
