"""Explicit schemas of the raw documents (bronze) and of the Parquet tables (silver).

Nothing is inferred at read time: a field a document lacks is NULL, so legislatures whose documents
differ still land in one table. A record with a field, at any depth, that isn't listed here also
keeps its whole source as a VARIANT (`SOURCE`) beside the typed columns; other records have none.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

STR, DATE, DBL, INT, BOOL, TS = (
    T.StringType(), T.DateType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
)
STRINGS = T.ArrayType(STR)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def list_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


# --- bronze -------------------------------------------------------------------------------------

VOTE_FIELDS = dict(
    id=STR, data=DATE, resultado=STR, descricao=STR, reuniao=STR, tipoReuniao=STR, unanime=STR,
    ausencias=STRINGS, detalhe=STR,
)
ACTIVITY_VOTE_FIELDS = {k: v for k, v in VOTE_FIELDS.items() if k != "tipoReuniao"}

# Comissao and Links differ in shape between legislatures and stay raw JSON text.
EVENT = struct(
    EvtId=STR, OevId=STR, Fase=STR, CodigoFase=STR, DataFase=DATE, ObsFase=STR,
    Votacao=list_of(**VOTE_FIELDS), Comissao=STR, AnexosFase=STRINGS, Links=STR, ActId=STR,
    ActividadesConjuntas=STRINGS, IniciativasConjuntas=STRINGS,
)

INITIATIVES_RAW = struct(
    IniNr=STR, IniTipo=STR, IniDescTipo=STR, IniLeg=STR, IniSel=STR, IniTitulo=STR,
    IniTextoSubst=STR, IniLinkTexto=STR, IniId=STR, IniEpigrafe=STR, IniObs=STR,
    IniTextoSubstCampo=STR, DataInicioleg=DATE, DataFimleg=DATE,
    IniAutorOutros=struct(sigla=STR, nome=STR),
    IniAutorDeputados=list_of(idCadastro=STR, nome=STR),
    IniAutorGruposParlamentares=list_of(GP=STR),
    IniAnexos=STRINGS, IniEventos=T.ArrayType(EVENT), IniciativasEuropeias=STR,
    IniciativasOrigem=STRINGS, IniciativasOriginadas=STRINGS, Links=STR, Peticoes=STRINGS,
    PropostasAlteracao=STR,
)
# Our own addition: an initiative too long for one bounded record comes as several records with
# the same IniId, Parte = 0, 1, 2, ... of Partes. Every part repeats the header; part 0 holds the
# earliest dated event. Records without the fields are whole (part 0 of 1).
PART_FIELD, PART_COUNT_FIELD = "Parte", "Partes"
INITIATIVES_READ = T.StructType(
    INITIATIVES_RAW.fields + [T.StructField(PART_FIELD, INT), T.StructField(PART_COUNT_FIELD, INT)]
)

#: The whole source of a record that holds more than what is declared.
SOURCE = "fonte"
VARIANT = T.VariantType()

INFO_BASE_RAW = struct(
    DetalheLegislatura=struct(sigla=STR, dtini=DATE, dtfim=DATE),
    Deputados=list_of(
        DepCadId=DBL, DepNomeParlamentar=STR, DepNomeCompleto=STR, DepCPDes=STR, DepCPId=DBL,
        DepGP=list_of(gpSigla=STR, gpDtInicio=DATE, gpDtFim=DATE, gpId=DBL),
        DepSituacao=list_of(sioDes=STR, sioDtInicio=DATE, sioDtFim=DATE),
    ),
    GruposParlamentares=list_of(sigla=STR, nome=STR),
    CirculosEleitorais=list_of(cpId=DBL, cpDes=STR),
    SessoesLegislativas=STRINGS,
)

ACTIVITY_RAW = struct(
    Assunto=STR, Tipo=STR, DescTipo=STR, Numero=STR, Sessao=STR, DataEntrada=DATE,
    DataAgendamentoDebate=DATE, DataAnuncio=DATE, AutoresGP=STRINGS, TipoAutor=STR,
    Publicacao=STRINGS, PublicacaoDebate=STRINGS, VotacaoDebate=list_of(**ACTIVITY_VOTE_FIELDS),
    Observacoes=STR,
)
ACTIVITIES_RAW = struct(AtividadesGerais=struct(Atividades=T.ArrayType(ACTIVITY_RAW)))

TOPICS_RAW = struct(ini_id=STR, legislatura=STR, cap=INT, cap_label=STR, model_version=STR)

# The base document of a legislature may come in parts too; their lists are joined in this order.
INFO_BASE_READ = T.StructType([*INFO_BASE_RAW.fields, T.StructField(PART_FIELD, INT)])

BRONZE = {
    "iniciativas": INITIATIVES_READ, "info_base": INFO_BASE_READ, "atividades": ACTIVITIES_RAW,
    "cap": TOPICS_RAW,
}

# --- column names -------------------------------------------------------------------------------


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


# Silver names which the word boundaries of the source name don't give.
_IRREGULAR = {"DataInicioleg": "data_inicio_leg", "DataFimleg": "data_fim_leg"}
# Activity fields that carry the ativ_ prefix in silver.
_ACTIVITY_PREFIXED = {"Assunto", "Tipo", "DescTipo", "Numero", "AutoresGP", "TipoAutor"}

INITIATIVE_NAMES = {n: _IRREGULAR.get(n, snake_case(n)) for n in INITIATIVES_RAW.names}
ACTIVITY_NAMES = {
    n: ("ativ_" if n in _ACTIVITY_PREFIXED else "") + snake_case(n)
    for n in [*ACTIVITY_RAW.names, "Legislatura"]
}

# --- silver -------------------------------------------------------------------------------------

POSITIONS = ("a_favor", "contra", "abstencao", "ausencia")
PARSED = struct(**{p: STRINGS for p in POSITIONS})


def _renamed(raw: T.StructType, names: dict[str, str], **more: T.DataType) -> T.StructType:
    kept = {names[f.name]: f.dataType for f in raw.fields}
    return struct(**kept, **more)


SILVER = {
    "iniciativas": _renamed(
        INITIATIVES_RAW, INITIATIVE_NAMES, ini_data=DATE, parte=INT, partes=INT, fonte=VARIANT, etl_timestamp=TS,
        legislatura=STR, longa=INT,  # 1: in several parts. Such records lie in files of their own.
    ),
    "votacoes": struct(
        vot_id=STR, ini_id=STR, ini_nr=STR, ini_titulo=STR, ini_tipo=STR, fase=STR, data_fase=DATE,
        data=DATE, resultado=STR, descricao=STR, reuniao=STR, tipo_reuniao=STR, unanime=STR,
        ausencias=STRINGS, detalhe=STR, detalhe_parsed=PARSED, is_nominal=BOOL,
        ini_autores_gp=STRINGS,  # our own addition: the initiative's author parties, never NULL
        legislatura=STR,
    ),
    "info_base": T.StructType([*INFO_BASE_READ.fields, T.StructField(SOURCE, VARIANT), T.StructField("legislatura", STR)]),
    "deputados": struct(
        dep_cad_id=DBL, nome_parlamentar=STR, nome_completo=STR, circulo_atual=STR, circulo_id=DBL,
        partido_atual=STR, situacao_atual=STR,
        partido_historico=list_of(gp_sigla=STR, gp_dt_inicio=DATE, gp_dt_fim=DATE, gp_id=DBL),
        situacao_historico=list_of(sio_des=STR, sio_dt_inicio=DATE, sio_dt_fim=DATE),
        legislatura=STR,
    ),
    "circulos": struct(cp_id=DBL, cp_des=STR, legislatura=STR),
    "partidos": struct(gp_sigla=STR, gp_nome=STR, legislatura=STR),
    "atividades": struct(
        ativ_id=STR, **{ACTIVITY_NAMES[f.name]: f.dataType for f in ACTIVITY_RAW.fields},
        fonte=VARIANT, etl_timestamp=TS, legislatura=STR,
    ),
    "atividades_votacoes": struct(
        vot_id=STR, ativ_id=STR, assunto=STR, tipo=STR, numero=STR, data_entrada=DATE,
        autores_gp=STRINGS, data=DATE, resultado=STR, descricao=STR, reuniao=STR, unanime=STR,
        ausencias=STRINGS, detalhe=STR, detalhe_parsed=PARSED, has_party_details=BOOL, source=STR,
        legislatura=STR,
    ),
    "cap": struct(ini_id=STR, cap=INT, cap_label=STR, model_version=STR, legislatura=STR),
}
CORE_DATASETS = ("iniciativas", "votacoes")

# Key columns that records are looked up by. They get Bloom filters, as no file order serves them.
LOOKUP_KEYS = {
    "iniciativas": ("ini_id",), "votacoes": ("vot_id",), "atividades": ("ativ_id",),
    "atividades_votacoes": ("vot_id",),
}

# Columns that may not be NULL in a result record (output contract).
REQUIRED = {
    "iniciativas": ("ini_nr", "legislatura"),
    "votacoes": ("vot_id", "ini_nr", "legislatura", "ini_titulo"),
    "info_base": ("legislatura",),
    "deputados": (
        "legislatura", "dep_cad_id", "nome_parlamentar", "nome_completo", "circulo_atual", "circulo_id",
    ),
    "circulos": ("legislatura", "cp_id", "cp_des"),
    "partidos": ("legislatura", "gp_sigla", "gp_nome"),
    "atividades": ("ativ_id", "legislatura"),
    "atividades_votacoes": ("vot_id", "ativ_id", "legislatura", "has_party_details", "source"),
    "cap": ("ini_id", "legislatura", "cap", "cap_label", "model_version"),
}

# The 22 topic codes and their Portuguese labels.
TOPIC_LABELS = {
    1: "Macroeconomia",
    2: "Direitos civis e liberdades",
    3: "Saúde",
    4: "Agricultura",
    5: "Trabalho e Emprego",
    6: "Educação",
    7: "Ambiente",
    8: "Energia",
    9: "Imigração",
    10: "Transportes",
    12: "Justiça e Crime",
    13: "Segurança Social",
    14: "Habitação",
    15: "Sistema bancário, assuntos financeiros e comércio interno",
    16: "Defesa",
    17: "Tecnologia",
    18: "Comércio internacional",
    19: "Relações externas",
    20: "Governo e Administração Pública",
    21: "Território e Recursos naturais",
    23: "Cultura, desporto e lazer",
    999: "Sem conteúdo político",
}
