"""Sources, sinks and the jobs that build the silver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from hemiciclo.catalog import flat
from hemiciclo.catalog.registry import big, entry, joined, rows
from hemiciclo.catalog.workspace import Workspace
from hemiciclo.fixtures import LEGISLATURES
from hemiciclo.plans import inventory, silver
from hemiciclo.plans.initiatives import headers
from hemiciclo.plans.legislatures import records
from hemiciclo.plans.silver import JOBS
from hemiciclo.schemas import PART_FIELD, POSITIONS, SILVER
from hemiciclo.sources import readers, writers
from hemiciclo.sources.document_check import check_documents, summarize_check



@entry("s1_json_array_documents", """
    SELECT legislatura, count(*) AS n, sum(n_events)::BIGINT AS n_events, count(DISTINCT ini_titulo) AS n_titles,
      min(data_inicio_leg) AS first_day FROM ini GROUP BY legislatura""")
def _(w: Workspace):
    raw = readers.read_documents(w.spark, "iniciativas", w.documents("iniciativas"), multiline=False)
    return raw.groupBy("legislatura").agg(
        F.count_if(F.coalesce(PART_FIELD, F.lit(0)) == 0).alias("n"), big(F.sum(F.array_size("IniEventos"))).alias("n_events"),
        F.countDistinct("IniTitulo").alias("n_titles"), F.min("DataInicioleg").alias("first_day"),
    )


@entry("s2_json_object_document", """
    SELECT b.legislatura, sigla, dtini, dtfim, n_circulos, n_grupos, n_deputados FROM base b
    JOIN (SELECT legislatura, count(*) AS n_circulos FROM circ GROUP BY 1) c ON c.legislatura = b.legislatura
    JOIN (SELECT legislatura, count(*) AS n_grupos FROM part GROUP BY 1) p ON p.legislatura = b.legislatura
    JOIN (SELECT legislatura, count(*) AS n_deputados FROM dep GROUP BY 1) d ON d.legislatura = b.legislatura""")
def _(w: Workspace):
    raw = readers.read_documents(w.spark, "info_base", w.documents("info_base"), multiline=False)
    head = raw.select("*", "DetalheLegislatura.*")
    return head.groupBy("legislatura", "sigla", "dtini", "dtfim").agg(
        big(F.sum(F.array_size("CirculosEleitorais"))).alias("n_circulos"),
        big(F.sum(F.array_size("GruposParlamentares"))).alias("n_grupos"),
        big(F.sum(F.array_size("Deputados"))).alias("n_deputados"),
    )


@entry("s3_wrapped_array", """
    SELECT legislatura, tipo, count(*) AS n, count(numero) AS n_numbered, count(data_entrada) AS n_dated
    FROM ativ GROUP BY legislatura, tipo""")
def _(w: Workspace):
    docs = readers.read_documents(w.spark, "atividades", w.documents("atividades"), multiline=False)
    return readers.activities_in(docs).groupBy("legislatura", F.col("Tipo").alias("tipo")).agg(
        rows().alias("n"), F.count("Numero").alias("n_numbered"), F.count("DataEntrada").alias("n_dated")
    )


@entry("s4_typed_csv", "SELECT ini_id, legislatura, cap, cap_label, model_version FROM topic")
def _(w: Workspace):
    return readers.read_topics(w.spark, w.documents("cap"))


@entry("s5_all_legislatures", """
    SELECT legislatura, count(*) AS n, count(data) AS n_dated, count(DISTINCT vot_id) AS n_ids
    FROM vot GROUP BY legislatura""")
def _(w: Workspace):
    w.build("votacoes")
    votes = readers.read_dataset(w.spark, w.silver, "votacoes", merge_schema=True)
    return votes.groupBy("legislatura").agg(
        rows().alias("n"), F.count("data").alias("n_dated"), F.countDistinct("vot_id").alias("n_ids")
    )


@entry("s6_optional_dataset", """
    SELECT legislatura, count(*) AS n_initiatives, CAST(0 AS BIGINT) AS n_topics FROM ini GROUP BY legislatura""")
def _(w: Workspace):
    w.build("iniciativas")
    topics = readers.read_dataset(w.spark, w.scratch(), "cap", optional=True)
    heads = headers(w.table("iniciativas")).select("legislatura", "ini_id")
    return heads.join(topics.select("ini_id", "cap"), "ini_id", "left").groupBy("legislatura").agg(
        rows().alias("n_initiatives"), F.count("cap").alias("n_topics")
    )


@entry("s7_document_check", """
    SELECT 'iniciativas' AS dataset, legislatura, count(*) AS n_records, true AS ok, CAST(0 AS BIGINT) AS max_missing_keys
    FROM ini GROUP BY legislatura
    UNION ALL SELECT 'info_base', legislatura, count(*), true, 0 FROM dep GROUP BY legislatura
    UNION ALL SELECT 'atividades', legislatura, count(*), true, 0 FROM ativ GROUP BY legislatura""")
def _(w: Workspace):
    out = None
    for dataset in ("iniciativas", "info_base", "atividades"):
        checked = summarize_check(check_documents(w.spark, dataset, w.documents(dataset), whole_files=False))
        out = checked if out is None else out.unionByName(checked)
    return out.drop("n_documents")


@entry("s8_required_datasets", """
    SELECT 'iniciativas' AS dataset, count(*) AS n FROM ini UNION ALL SELECT 'votacoes', count(*) FROM vot""")
def _(w: Workspace):
    w.build("votacoes")
    readers.require_datasets(w.spark, w.silver)
    return inventory.inventory(w.spark, w.silver, ["iniciativas", "votacoes"]).select("dataset", F.col("n_rows").alias("n"))


@entry("k1_parquet_write", """
    SELECT legislatura, count(*) AS n, sum(CASE WHEN is_nominal THEN 1 ELSE 0 END)::BIGINT AS n_nominal,
      max(data) AS last_day FROM vot GROUP BY legislatura""")
def _(w: Workspace):
    path = w.scratch()
    writers.write_dataset(w.table("votacoes"), path, LEGISLATURES)
    return w.spark.read.schema(SILVER["votacoes"]).parquet(path).groupBy("legislatura").agg(
        rows().alias("n"), F.count_if("is_nominal").alias("n_nominal"), F.max("data").alias("last_day")
    )


@entry("k2_clustered_write", """
    SELECT legislatura, count(*) AS n, CAST(0 AS BIGINT) AS n_unsorted_rows, CAST(0 AS BIGINT) AS n_overlapping_files
    FROM vot GROUP BY legislatura""")
def _(w: Workspace):
    """Order inside each file against the row before; order between files by their bounds."""
    stored = w.table("votacoes").select(
        "legislatura", "data", "vot_id", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    # Days run backwards; undated rows come last.
    rank = F.struct(
        F.coalesce(-F.unix_date("data"), F.lit(2**31 - 1)).alias("day"), F.col("vot_id").alias("id")
    )
    ranked = stored.withColumn("rank", rank)
    # A file and a stretch of it: windows are bounded by the stretch, not by the file.
    stretch = F.floor(F.col("at") / 100_000)
    before = F.lag("rank").over(Window.partitionBy("file", "legislatura", stretch).orderBy("at"))
    by_stretch = ranked.withColumns(
        {"unsorted": F.coalesce(F.col("rank") < before, F.lit(False)), "stretch": stretch}
    ).groupBy("legislatura", "file", "stretch").agg(
        rows().alias("n"), F.count_if("unsorted").alias("n_unsorted_rows"),
        F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.min_by("rank", "at").alias("first"), F.max_by("rank", "at").alias("last"),
    )
    # The first row of a stretch against the last one of the stretch before.
    border = F.lag("last").over(Window.partitionBy("file", "legislatura").orderBy("stretch"))
    by_file = by_stretch.withColumn("torn", F.coalesce(F.col("first") < border, F.lit(False)).cast("int")).groupBy(
        "legislatura", "file"
    ).agg(
        F.sum("n").alias("n"), F.sum(F.col("n_unsorted_rows") + F.col("torn")).alias("n_unsorted_rows"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    previous = F.lag("high").over(Window.partitionBy("legislatura").orderBy("low"))
    return by_file.withColumn("overlaps", F.coalesce(F.col("low") < previous, F.lit(False))).groupBy(
        "legislatura"
    ).agg(
        F.sum("n").alias("n"), F.sum("n_unsorted_rows").alias("n_unsorted_rows"),
        F.count_if("overlaps").alias("n_overlapping_files"),
    )


@entry("k3_replace_one_legislature", """
    SELECT legislatura, CASE WHEN legislatura = 'L17' THEN 'new' ELSE 'old' END AS state, count(*) AS n
    FROM vot GROUP BY legislatura""")
def _(w: Workspace):
    path = w.scratch()
    votes = w.table("votacoes").select("vot_id", F.lit("old").alias("state"), "legislatura")
    writers.write_dataset(votes, path)
    writers.write_dataset(votes.where(F.col("legislatura") == "L17").withColumn("state", F.lit("new")), path, ["L17"])
    return w.spark.read.parquet(path).groupBy("legislatura", "state").agg(rows().alias("n"))


@entry("k4_write_statistics", """
    SELECT 'atividades' AS dataset, legislatura, 'ok' AS status, count(*) AS rows, true AS measured
    FROM ativ GROUP BY legislatura""")
def _(w: Workspace):
    w.documents("atividades")
    report = silver.run_all(w.spark, w.bronze, w.scratch(), LEGISLATURES, ["atividades"], multiline=False)
    return report.select(
        "dataset", "legislatura", "status", "rows", (F.col("compression_ratio") > 0).alias("measured")
    )


def _lists():
    """The parsed lists as text; an empty one and none at all look alike."""
    parsed = {p: F.col(f"detalhe_parsed.{p}") for p in POSITIONS}
    return [F.when(F.array_size(c) > 0, joined(c)).alias(p) for p, c in parsed.items()]


# --- jobs ---------------------------------------------------------------------------------------


@entry("t1_initiatives", flat.INITIATIVE_SQL)
def _(w: Workspace):
    """All columns of the table, its events counted."""
    table = w.table("iniciativas")
    sizes = table.groupBy("ini_id").agg(F.sum(F.array_size("ini_eventos.EvtId")).alias("n_events"))
    return headers(table).select(*flat.initiative_columns(), "ini_data").join(sizes, "ini_id")


@entry("t2_info_base", """
    SELECT b.legislatura, sigla, dtini, dtfim, dep_cad_id, nome_completo FROM base b
    JOIN dep ON dep.legislatura = b.legislatura""")
def _(w: Workspace):
    """From the one nested record of each legislature."""
    return records(w.table("info_base")).select("legislatura", "DetalheLegislatura.*", F.explode("Deputados").alias("d")).select(
        "legislatura", "sigla", "dtini", "dtfim", F.col("d.DepCadId").alias("dep_cad_id"),
        F.col("d.DepNomeCompleto").alias("nome_completo"),
    )


@entry("t3_votes", """
    SELECT vot_id, ini_id, ini_nr, legislatura, ini_titulo, ini_tipo, fase, data_fase, data, resultado, reuniao,
      tipo_reuniao, unanime, is_nominal, parsed, a_favor, contra, abstencao, ausencia
    FROM vot LEFT JOIN (
      SELECT vot_id AS id, string_agg(party, '|' ORDER BY party) FILTER (position = 'a_favor') AS a_favor,
        string_agg(party, '|' ORDER BY party) FILTER (position = 'contra') AS contra,
        string_agg(party, '|' ORDER BY party) FILTER (position = 'abstencao') AS abstencao,
        string_agg(party, '|' ORDER BY party) FILTER (position = 'ausencia') AS ausencia FROM pos GROUP BY vot_id
    ) ON id = vot_id""")
def _(w: Workspace):
    return silver.votes(w.table("iniciativas")).select(
        "vot_id", "ini_id", "ini_nr", "legislatura", "ini_titulo", "ini_tipo", "fase", "data_fase", "data",
        "resultado", "reuniao", "tipo_reuniao", "unanime", "is_nominal",
        F.col("detalhe_parsed").isNotNull().alias("parsed"), *_lists(),
    )


@entry("t4_deputies", """
    SELECT legislatura, dep_cad_id, nome_parlamentar, nome_completo, circulo_atual, circulo_id, partido_atual,
      situacao_atual, parties, states
    FROM dep LEFT JOIN (
      SELECT c_custkey AS k, string_agg(gp, '>' ORDER BY n) AS parties FROM dep_gp GROUP BY c_custkey
    ) h ON k = c_custkey
    JOIN (SELECT c_custkey AS s, CASE c_custkey % 3 WHEN 0 THEN 'Efetivo' WHEN 1 THEN 'Efetivo>Renunciou'
      ELSE 'Suplente' END AS states FROM customer) t ON s = c_custkey""")
def _(w: Workspace):
    parties = F.col("partido_historico.gp_sigla")
    return w.table("deputados").select(
        "legislatura", "dep_cad_id", "nome_parlamentar", "nome_completo", "circulo_atual", "circulo_id",
        "partido_atual", "situacao_atual", F.when(F.array_size(parties) > 0, F.array_join(parties, ">")).alias("parties"),
        F.array_join("situacao_historico.sio_des", ">").alias("states"),
    )


@entry("t5_circles", "SELECT legislatura, cp_id, cp_des FROM circ")
def _(w: Workspace):
    return w.table("circulos").select("legislatura", "cp_id", "cp_des")


@entry("t6_parties", "SELECT legislatura, gp_sigla, gp_nome FROM part")
def _(w: Workspace):
    return w.table("partidos").select("legislatura", "gp_sigla", "gp_nome")


@entry("t7_activities", flat.ACTIVITY_SQL)
def _(w: Workspace):
    """All columns of the table, lists and votes as text."""
    return w.table("atividades").select("ativ_id", "legislatura", *flat.activity_columns())


@entry("t8_activity_votes", """
    SELECT vot_id, ativ_id, legislatura, assunto, tipo, numero, data_entrada, data, resultado, has_party_details,
      'atividade' AS source, a_favor, contra, abstencao, CAST(NULL AS VARCHAR) AS ausencia
    FROM avot LEFT JOIN (
      SELECT vot_id AS id, string_agg(party, '|' ORDER BY party) FILTER (position = 'a_favor') AS a_favor,
        string_agg(party, '|' ORDER BY party) FILTER (position = 'contra') AS contra,
        string_agg(party, '|' ORDER BY party) FILTER (position = 'abstencao') AS abstencao FROM apos GROUP BY vot_id
    ) ON id = vot_id""")
def _(w: Workspace):
    return silver.activity_votes(w.table("atividades")).select(
        "vot_id", "ativ_id", "legislatura", "assunto", "tipo", "numero", "data_entrada", "data", "resultado",
        "has_party_details", "source", *_lists(),
    )


@entry("t9_topics", "SELECT legislatura, ini_id, cap, cap_label, model_version FROM topic")
def _(w: Workspace):
    return w.table("cap")


@entry("t10_run_all", """
    SELECT dataset, legislatura, 'ok' AS status, n AS rows FROM (
      SELECT 'iniciativas' AS dataset, legislatura, count(*) AS n FROM ini GROUP BY legislatura
      UNION ALL SELECT 'votacoes', legislatura, count(*) FROM vot GROUP BY legislatura
      UNION ALL SELECT 'info_base', legislatura, 1 FROM base
      UNION ALL SELECT 'deputados', legislatura, count(*) FROM dep GROUP BY legislatura
      UNION ALL SELECT 'circulos', legislatura, count(*) FROM circ GROUP BY legislatura
      UNION ALL SELECT 'partidos', legislatura, count(*) FROM part GROUP BY legislatura
      UNION ALL SELECT 'atividades', legislatura, count(*) FROM ativ GROUP BY legislatura
      UNION ALL SELECT 'atividades_votacoes', legislatura, count(*) FROM avot GROUP BY legislatura
      UNION ALL SELECT 'cap', legislatura, count(*) FROM topic GROUP BY legislatura)""")
def _(w: Workspace):
    for dataset in ("iniciativas", "info_base", "atividades", "cap"):
        w.documents(dataset)
    report = silver.run_all(w.spark, w.bronze, w.scratch(), LEGISLATURES, tuple(JOBS), multiline=False)
    return report.select("dataset", "legislatura", "status", "rows")
