"""Bronze documents to silver tables: one Spark job a dataset over all requested legislatures."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.functions.columns import (
    activity_key, as_structs, first_date, has_text, is_nominal, last_of, picked, rename_to,
)
from hemiciclo.functions.positions import parse_positions
from hemiciclo.plans.initiatives import AUTHOR_GROUPS
from hemiciclo.schemas import ACTIVITY_NAMES, ACTIVITY_RAW, INITIATIVE_NAMES, LOOKUP_KEYS, PART_COUNT_FIELD, PART_FIELD, SILVER, SOURCE
from hemiciclo.sources.readers import activities_in, bronze_path, is_packed, legislature_in_path, path_exists, read_documents, read_topics
from hemiciclo.sources.writers import INPUT_BYTES_PER_TASK, cluster, input_bytes, legislature_of_slice, stored_bytes, write_dataset

log = logging.getLogger(__name__)

#: A table made of another that has more bytes than this is clustered a legislature at a time.
AT_ONCE_BYTES = 2**30
#: Bytes of documents behind a byte of their packed files; those of the given tables pack into a tenth.
PACKED = 10


def initiatives(documents: DataFrame) -> DataFrame:
    """Renamed columns plus the date of the first event. Map-only."""
    return documents.select(
        *rename_to(INITIATIVE_NAMES),
        first_date("IniEventos", "DataFase").alias("ini_data"),
        F.coalesce(PART_FIELD, F.lit(0)).alias("parte"),
        F.coalesce(PART_COUNT_FIELD, F.lit(1)).alias("partes"), SOURCE,
        F.current_timestamp().alias("etl_timestamp"),
        "legislatura", (F.coalesce(PART_COUNT_FIELD, F.lit(1)) > 1).cast("int").alias("longa"),
    )


def vote_rows(initiatives: DataFrame) -> DataFrame:
    """Votes of the events of the initiatives, still unparsed.

    Each brings its initiative's author parties along, as every part of an initiative has them: reports by author
    then need no join of votes with initiatives.
    """
    head = ["ini_id", "ini_nr", "legislatura", "ini_titulo", "ini_tipo"]
    authors = F.coalesce(F.col(AUTHOR_GROUPS), F.array().cast("array<string>")).alias("ini_autores_gp")
    events = initiatives.select(*head, authors, F.explode(picked("ini_eventos", "Fase", "DataFase", "Votacao")).alias("e"))
    votes = events.select(
        *head, "ini_autores_gp", F.col("e.Fase").alias("fase"), F.col("e.DataFase").alias("data_fase"),
        F.explode("e.Votacao").alias("v"),
    )
    return votes.select(
        F.col("v.id").alias("vot_id"), *head, "fase", "data_fase", "v.data", "v.resultado", "v.descricao",
        "v.reuniao", F.col("v.tipoReuniao").alias("tipo_reuniao"), "v.unanime", "v.ausencias", "v.detalhe", "ini_autores_gp",
    )


def vote_details(rows: DataFrame) -> DataFrame:
    """Parsed after the clustering shuffle, which then moves only the text."""
    return parse_positions(rows).withColumn("is_nominal", is_nominal(F.col("detalhe"))).select(
        *SILVER["votacoes"].names
    )


def votes(initiatives: DataFrame) -> DataFrame:
    return vote_details(vote_rows(initiatives))


def info_base(documents: DataFrame) -> DataFrame:
    return documents.select(*SILVER["info_base"].names)


def deputies(info_base: DataFrame) -> DataFrame:
    d = info_base.select("legislatura", F.explode("Deputados").alias("d"))
    return d.select(
        F.col("d.DepCadId").alias("dep_cad_id"), F.col("d.DepNomeParlamentar").alias("nome_parlamentar"),
        F.col("d.DepNomeCompleto").alias("nome_completo"), F.col("d.DepCPDes").alias("circulo_atual"),
        F.col("d.DepCPId").alias("circulo_id"), last_of("d.DepGP")["gpSigla"].alias("partido_atual"),
        last_of("d.DepSituacao")["sioDes"].alias("situacao_atual"),
        as_structs("d.DepGP", {
            "gpSigla": "gp_sigla", "gpDtInicio": "gp_dt_inicio", "gpDtFim": "gp_dt_fim", "gpId": "gp_id",
        }).alias("partido_historico"),
        as_structs("d.DepSituacao", {
            "sioDes": "sio_des", "sioDtInicio": "sio_dt_inicio", "sioDtFim": "sio_dt_fim",
        }).alias("situacao_historico"),
        "legislatura",
    )


def circles(info_base: DataFrame) -> DataFrame:
    c = info_base.select("legislatura", F.explode("CirculosEleitorais").alias("c"))
    return c.select(F.col("c.cpId").alias("cp_id"), F.col("c.cpDes").alias("cp_des"), "legislatura")


def parties(info_base: DataFrame) -> DataFrame:
    g = info_base.select("legislatura", F.explode("GruposParlamentares").alias("g"))
    return g.select(F.col("g.sigla").alias("gp_sigla"), F.col("g.nome").alias("gp_nome"), "legislatura")


def activities(documents: DataFrame) -> DataFrame:
    key = activity_key(
        F.col("legislatura"), F.col("Tipo"), F.col("Numero"), F.col("Assunto"), F.col("DataEntrada")
    )
    return activities_in(documents).select(
        key.alias("ativ_id"), *rename_to({n: ACTIVITY_NAMES[n] for n in ACTIVITY_RAW.names}), SOURCE,
        F.current_timestamp().alias("etl_timestamp"), "legislatura",
    )


def activity_vote_rows(activities: DataFrame) -> DataFrame:
    rows = activities.select(
        "ativ_id", F.col("ativ_assunto").alias("assunto"), F.col("ativ_tipo").alias("tipo"),
        F.col("ativ_numero").alias("numero"), "legislatura", "data_entrada",
        F.col("ativ_autores_gp").alias("autores_gp"), F.explode("votacao_debate").alias("v"),
    )
    return rows.select(F.col("v.id").alias("vot_id"), *[c for c in rows.columns if c != "v"], *[
        f"v.{f}" for f in ("data", "resultado", "descricao", "reuniao", "unanime", "ausencias", "detalhe")
    ])


def activity_vote_details(rows: DataFrame) -> DataFrame:
    out = parse_positions(rows).withColumns(
        {"has_party_details": has_text("detalhe"), "source": F.lit("atividade")}
    )
    return out.select(*SILVER["atividades_votacoes"].names)


def activity_votes(activities: DataFrame) -> DataFrame:
    return activity_vote_details(activity_vote_rows(activities))


def topics(rows: DataFrame) -> DataFrame:
    return rows.select(*SILVER["cap"].names)


@dataclass(frozen=True)
class Job:
    """``build`` makes the rows, ``order`` clusters them, ``finish`` adds what needn't be shuffled.

    ``records`` counts what a legislature's rows stand for, if not themselves. ``closed``: rows take their
    legislature from where they were found, not from what they say, so there are none of others.
    ``halves`` names a column of 0 and 1 that divides the files of a legislature.
    """

    build: Callable[[DataFrame], DataFrame]
    parent: str | None = None
    order: Callable[[], list[Column]] | None = None
    finish: Callable[[DataFrame], DataFrame] = lambda df: df
    optional: bool = True
    records: Callable[[Column], Column] | None = None
    closed: bool = True
    halves: str | None = None

    def plan(self, source: DataFrame, packed: int = 1) -> DataFrame:
        """``packed``: bytes behind a byte of the source's files, if more than those of a table."""
        rows = self.build(source)
        return self.finish(cluster(rows, self.order(), INPUT_BYTES_PER_TASK // packed) if self.order else rows)


def _recent_votes() -> list[Column]:
    return [F.col("data").desc_nulls_last(), F.col("vot_id").asc()]


JOBS: dict[str, Job] = {
    "iniciativas": Job(initiatives, optional=False, records=lambda mine: F.count_if(mine & (F.col("parte") == 0)), halves="longa"),
    "votacoes": Job(vote_rows, "iniciativas", _recent_votes, vote_details),
    # One record a legislature, in as many rows as documents.
    "info_base": Job(info_base, records=lambda mine: F.coalesce(F.max(mine.cast("int")), F.lit(0))),
    "deputados": Job(deputies, "info_base", lambda: [F.col("nome_parlamentar").asc_nulls_last(), F.col("dep_cad_id")]),
    "circulos": Job(circles, "info_base", lambda: [F.col("cp_des").asc_nulls_last(), F.col("cp_id")]),
    "partidos": Job(parties, "info_base", lambda: [F.col("gp_sigla").asc_nulls_last()]),
    "atividades": Job(activities, order=lambda: [F.col("data_entrada").desc_nulls_last(), F.col("ativ_id")]),
    "atividades_votacoes": Job(activity_vote_rows, "atividades", _recent_votes, activity_vote_details),
    "cap": Job(topics, order=lambda: [F.col("ini_id").asc_nulls_last()], closed=False),
}


def run_job(
    spark: SparkSession, name: str, bronze: str, silver: str, legislatures: Sequence[str], multiline: bool = True
) -> dict[str | None, int]:
    """Write one dataset for these legislatures in one job; gives their row counts, under None that of the strays.

    A large table of children is written in a job a legislature, so that their shuffles don't fill the disk together.
    """
    job, packed = JOBS[name], 1
    if job.parent:
        source = spark.read.schema(SILVER[job.parent]).parquet(f"{silver}/{job.parent}")
        source = source.where(F.col("legislatura").isin(list(legislatures)))
        if job.order and job.closed and len(legislatures) > 1 and input_bytes(source) > AT_ONCE_BYTES:
            return {k: n for leg in legislatures for k, n in run_job(spark, name, bronze, silver, [leg], multiline).items()}
    else:
        paths = [p for leg in legislatures if (p := bronze_path(spark, bronze, name, leg))]
        packed = PACKED if any(is_packed(spark, p) for p in paths) else 1
        source = read_topics(spark, paths) if name == "cap" else read_documents(spark, name, paths, multiline)
    strays = f"{silver}/strays/{name}/asked={'-'.join(sorted(legislatures))}"
    return write_dataset(job.plan(source, packed), f"{silver}/{name}", legislatures, LOOKUP_KEYS.get(name, ()), job.records, strays, job.closed, job.halves)


def run_all(
    spark: SparkSession, bronze: str, silver: str, legislatures: Sequence[str],
    include: Sequence[str] = tuple(JOBS), multiline: bool = True,
) -> DataFrame:
    """Run the chosen jobs; gives (dataset, legislatura, status, rows, bytes, bronze_bytes).

    Each dataset is one job over all legislatures. If it fails it runs again a legislature at a
    time, so that only the bad ones fail; what depends on them is skipped. Status: ok, failed,
    missing (no such optional document), skipped (its input isn't there). A dataset with rows of
    legislatures that weren't asked for has one more row, without a legislature and with the status
    diverted: so many rows lie in ``strays/<dataset>/asked=<legislatures>`` instead.
    """
    status: dict[tuple[str, str | None], str] = {}
    counts: dict[tuple[str, str | None], int] = {}
    for name in [n for n in JOBS if n in include]:
        job = JOBS[name]
        ready = []
        for leg in legislatures:
            if job.parent:
                # A parent that isn't run now may lie there from before.
                there = status[job.parent, leg] == "ok" if (job.parent, leg) in status else path_exists(
                    spark, f"{silver}/{job.parent}/legislatura={leg}"
                )
                otherwise = "skipped"
            else:
                there = bronze_path(spark, bronze, name, leg) is not None
                otherwise = "missing" if job.optional else "failed"
            if there:
                ready.append(leg)
            else:
                status[name, leg] = otherwise
        for batch in [ready] if ready else []:
            done = _attempt(spark, name, bronze, silver, batch, multiline)
            if done is None and len(batch) > 1:
                done = {}
                for leg in batch:
                    one = _attempt(spark, name, bronze, silver, [leg], multiline) or {}
                    done |= {k: n + done.get(k, 0) for k, n in one.items()}
            for leg in batch:
                status[name, leg] = "ok" if leg in (done or {}) else "failed"
            if None in (done or {}):
                status[name, None] = "diverted"
            counts |= {(name, leg): n for leg, n in (done or {}).items()}
    return _report(spark, bronze, silver, status, counts)


def _attempt(spark, name, bronze, silver, legislatures, multiline) -> dict[str | None, int] | None:
    try:
        return run_job(spark, name, bronze, silver, legislatures, multiline)
    except Exception as e:  # a failed dataset must not stop the others
        log.error("job %s failed for %s: %s", name, ", ".join(legislatures), str(e).split("\n")[0])
        return None


def _report(spark, bronze, silver, status, counts) -> DataFrame:
    """At most datasets x legislatures rows."""
    def sizes(path: str, legislature: Column) -> dict[str, int]:
        return {r.legislatura: r.bytes for r in stored_bytes(spark, path, legislature).collect()}

    written = {n for (n, _), s in status.items() if s == "ok"}
    after = {n: sizes(f"{silver}/{n}", legislature_of_slice()) for n in written}
    before = {}
    for n in written:
        if JOBS[n].parent is None:
            paths = [p for (m, leg), s in status.items() if m == n and s == "ok"
                     and (p := bronze_path(spark, bronze, n, leg))]
            before[n] = sizes(paths, legislature_in_path(F.col("path")))
    rows = [
        (n, leg, s, counts.get((n, leg)), after.get(n, {}).get(leg) if s == "ok" else None,
         before.get(n, {}).get(leg) if s == "ok" else None)
        for (n, leg), s in status.items()
    ]
    out = spark.createDataFrame(
        rows, "dataset string, legislatura string, status string, rows bigint, bytes bigint, bronze_bytes bigint"
    )
    return out.withColumn("compression_ratio", F.round(F.col("bronze_bytes") / F.col("bytes"), 2))
