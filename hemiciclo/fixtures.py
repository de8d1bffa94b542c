"""The given star-schema tables shaped into raw parliamentary documents.

Orders become initiatives, line items their events and votes, events activities, customers
deputies, nations circles. No document holds an unbounded group: an initiative with very many
events, or the deputies of a legislature, come in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.operators.skew import oversized_keys, small_side
from hemiciclo.schemas import TOPIC_LABELS
from hemiciclo.sources.shared import settled, shuffles_removed

PARTIES = ("PS", "PSD", "CH", "IL", "BE", "PCP", "L", "PAN", "CDS-PP", "JPP")
LEGISLATURES = ("L13", "L14", "L15", "L16", "L17")
PHASES = (
    "Entrada", "Admissão", "Votação na generalidade", "Baixa comissão especialidade",
    "Votação na especialidade", "Votação final global",
)
ROMAN = {"L13": "XIII", "L14": "XIV", "L15": "XV", "L16": "XVI", "L17": "XVII"}
MAX_EVENTS = 1000      # events of one initiative record
ROWS_PER_DOCUMENT = 1000  # scanned rows behind one deputies or activities document
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_COMPRESSION"}
#: Packed files don't split, so they are kept short.
PACKED_RECORDS = {"iniciativas": 20_000, "cap": 500_000, "info_base": 100, "atividades": 100}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legislature_of(n: Column) -> Column:
    return F.concat(F.lit("L"), (13 + n % 5).cast("string"))


def parties_where(condition) -> Column:
    """The parties (i, code) for which ``condition(i)`` holds, in order."""
    return F.array_compact(F.array(*[F.when(condition(i), gp) for i, gp in enumerate(PARTIES)]))


def _by_index(index: Column, names=PARTIES) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _array(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


# --- votes and events ---------------------------------------------------------------------------


def _tags(codes: Column) -> Column:
    return F.transform(codes, lambda gp: F.concat(F.lit("<I>"), gp, F.lit("</I>")))


def _initiative_vote_text() -> Column:
    """The vote record of a line item; noise the parser must drop grows with the quantity."""
    part, quantity = F.col("l_partkey"), F.col("l_quantity")

    def voting(remainder: int) -> Column:
        return _tags(parties_where(
            lambda i: ((part + i) % 7 != 0) & ((part + i) % 3 == remainder)
        ))

    def when(condition: Column, *tokens: str) -> Column:
        return F.when(condition, _array(*tokens)).otherwise(_array())

    favour = F.concat(
        voting(0),
        when((F.col("l_linenumber") == 6) & (part % 2 == 0), "Membro Exemplo (Ninsc)"),
        when(quantity >= 40, "6-PSD", "Maria Exemplo (PS)", "12"),
        when(quantity >= 48, *[f"Deputado Exemplo {k} (PSD)" for k in range(1, 61)]),
    )
    absent = F.array_join(_tags(parties_where(lambda i: (part + i) % 7 == 0)), ", ")

    def section(title: str, tokens: Column) -> Column:
        return F.concat(F.lit(f"{title}: "), F.array_join(tokens, ", "))

    return F.concat_ws(
        "<BR>",
        F.when(quantity == 25, "Contra: <I>ZZ</I>"),
        section("A Favor", favour), section("Contra", voting(1)), section("Abstenção", voting(2)),
        F.when(quantity < 10, F.concat(F.lit("Ausência: "), absent))
        .when(quantity < 20, F.concat(F.lit("Ausencia: "), absent)),
    )


def _some(condition: Column, *parts: str | Column) -> Column:
    """A text of ``parts`` on a share of the rows: fields that few records have."""
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _few(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items))


def _phase_day() -> Column:
    return F.when(F.col("l_suppkey") % 11 != 0, F.col("l_shipdate").cast("date"))


def _event(event_id: Column) -> Column:
    supplier, shipped, number, part = F.col("l_suppkey"), F.col("l_shipdate").cast("date"), F.col("l_linenumber"), F.col("l_partkey")
    unanimous = supplier % 7 == 0
    vote = F.struct(
        F.concat(event_id, F.lit("-v")).alias("id"),
        F.when(supplier % 13 != 0, F.date_add(shipped, 1)).alias("data"),
        F.when(supplier % 17 == 0, None).when(F.col("l_returnflag") == "A", "Aprovado")
        .otherwise("Rejeitado").alias("resultado"),
        _some(supplier % 10 == 1, "Requerimento ", number).alias("descricao"),
        number.cast("string").alias("reuniao"),
        F.lit("RP").alias("tipoReuniao"),
        F.when(unanimous, "unanime").alias("unanime"),
        _few(supplier % 12 == 2, _by_index(F.col("l_partkey") % 10), F.lit("ZZ")).alias("ausencias"),
        F.when(~unanimous, _initiative_vote_text()).when(F.col("l_partkey") % 3 == 0, "   ").alias("detalhe"),
    )
    votes = F.when(F.col("l_returnflag") != "N", F.array(vote)).when(
        F.col("l_linenumber") % 2 == 0, F.array().cast(f"array<{_VOTE_TYPE}>")
    )
    phase = F.when(F.col("l_linenumber") <= len(PHASES), F.element_at(
        F.array(*[F.lit(p) for p in PHASES]), F.least("l_linenumber", F.lit(len(PHASES)))
    ))
    tenth, twentieth = supplier % 10, supplier % 20
    return F.struct(
        event_id.alias("EvtId"), phase.alias("Fase"),
        _phase_day().alias("DataFase"), votes.alias("Votacao"),
        _some(tenth == 0, "oev-", event_id).alias("OevId"), _some(tenth == 2, number + 100).alias("CodigoFase"),
        _some(tenth == 3, "Obs ", event_id).alias("ObsFase"), _some(tenth == 4, "Comissão ", supplier % 12).alias("Comissao"),
        _few(twentieth == 5, F.concat(F.lit("af-"), event_id), F.lit("anexo")).alias("AnexosFase"),
        _some(tenth == 6, "https://example.org/fase/", number).alias("Links"), _some(tenth == 7, part).alias("ActId"),
        _few(twentieth == 8, F.concat(F.lit("aj-"), number.cast("string"))).alias("ActividadesConjuntas"),
        _few(twentieth == 9, part.cast("string"), F.concat(part.cast("string"), F.lit("b"))).alias("IniciativasConjuntas"),
    )


_VOTE_TYPE = (
    "struct<id:string,data:date,resultado:string,descricao:string,reuniao:string,tipoReuniao:string,"
    "unanime:string,ausencias:array<string>,detalhe:string>"
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_shipdate",
        # Where the row is stored: tells apart even exact copies, and the same on every attempt.
        F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("row_id"),
    )


def _nested(lines: DataFrame, *keys: str) -> DataFrame:
    """Events by key. The narrow rows are shuffled first and the event texts made after that; the
    grouping needs no second shuffle."""
    event_id = F.concat_ws("-", "o_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    events = lines.repartition(*[F.col(k) for k in keys]).select(*keys, _event(event_id).alias("event"))
    return events.groupBy(*keys).agg(F.sort_array(F.collect_list("event")).alias("IniEventos"))


def _initiative_records(spark: SparkSession, sf_dir: str, max_events: int) -> DataFrame:
    """(orders columns, IniEventos, Parte, Partes)."""
    lines, orders = _lines(spark, sf_dir), table(spark, sf_dir, "orders")
    crowded = settled(oversized_keys(lines, "o_orderkey", max_events))
    if crowded.isEmpty():
        return _whole(orders, lines)
    crowded = small_side(crowded)
    whole = _whole(orders.join(crowded, "o_orderkey", "left_anti"), lines.join(crowded, "o_orderkey", "left_anti"))
    salted = lines.join(crowded, "o_orderkey").withColumn("salt", F.pmod("row_id", "n_parts"))
    undated = F.to_date(F.lit("9999-12-31"))
    # The part with the earliest event is part 0; the minimum is combined before the shuffle.
    lead = settled(salted.groupBy("o_orderkey").agg(
        F.min_by("salt", F.struct(F.coalesce(_phase_day(), undated), "salt")).alias("lead")
    ))
    parts = _nested(salted, "o_orderkey", "salt", "n_parts").join(small_side(lead), "o_orderkey").select(
        "o_orderkey", "IniEventos", F.col("n_parts").alias("Partes"),
        F.when(F.col("salt") == F.col("lead"), 0).otherwise(
            F.col("salt") + (F.col("salt") < F.col("lead")).cast("int")
        ).cast("int").alias("Parte"),
    )
    heads = settled(orders.join(crowded, "o_orderkey", "left_semi"))
    return whole.unionByName(small_side(heads).join(parts, "o_orderkey"))


def _whole(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with at most MAX_EVENTS events, nested in one record; orders without any stay."""
    nested = _nested(lines, "o_orderkey")
    empty = F.array().cast(nested.schema["IniEventos"].dataType)
    return orders.join(nested, "o_orderkey", "left").withColumn(
        "IniEventos", F.coalesce("IniEventos", empty)
    ).withColumns({"Parte": F.lit(0), "Partes": F.lit(1)})


def _begins(number: Column) -> Column:
    """First day of a legislature, counted from L13 as 0."""
    return F.date_add(F.to_date(F.lit("1995-01-01")), (365 * number).cast("int"))


def initiatives(spark: SparkSession, sf_dir: str, max_events: int = MAX_EVENTS) -> DataFrame:
    """Raw initiative records with their legislature."""
    records = _initiative_records(spark, sf_dir, max_events)
    key, customer, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    ini_id = key.cast("string")
    author = parties_where(lambda i: (customer + i) % 4 == 0)
    twice = F.array(_by_index((4 - customer % 4) % 4))
    authors = F.when(customer % 10 == 0, None).when(customer % 10 == 1, _array()).when(
        customer % 50 == 7, F.concat(author, twice)
    ).otherwise(author)

    def signer(number: Column) -> Column:
        return F.struct(number.cast("string").alias("idCadastro"), _some(number % 4 == 0, "Deputado ", number).alias("nome"))

    return records.select(
        legislature_of(key).alias("leg"),
        ini_id.alias("IniId"), (key % 400).cast("string").alias("IniNr"),
        F.when(status == "F", "J").when(status == "O", "R").otherwise("P").alias("IniTipo"),
        F.when(status == "F", "Projeto de Lei").when(status == "O", "Projeto de Resolução")
        .otherwise("Proposta de Lei").alias("IniDescTipo"),
        F.concat(F.lit("Iniciativa "), "o_orderpriority", F.lit(" nº "), ini_id).alias("IniTitulo"),
        _begins(key % 5).alias("DataInicioleg"), F.when(key % 5 != 4, F.date_add(_begins(key % 5), 364)).alias("DataFimleg"),
        _some(key % 10 == 0, _by_index(key % 5, tuple(ROMAN.values()))).alias("IniLeg"), _some(key % 10 == 1, key % 4 + 1).alias("IniSel"),
        _some(key % 10 == 2, "SIM").alias("IniTextoSubst"), _some(key % 10 == 3, "https://example.org/texto/", key).alias("IniLinkTexto"),
        _some(key % 11 == 0, "Epígrafe ", key).alias("IniEpigrafe"), _some(key % 11 == 1, "Obs ", key).alias("IniObs"),
        _some(key % 11 == 2, "Campo ", key).alias("IniTextoSubstCampo"), _some(key % 17 == 0, "COM(", key, ")").alias("IniciativasEuropeias"),
        _some(key % 17 == 1, '[{"url":"https://example.org/', key, '"}]').alias("Links"), _some(key % 17 == 2, "PA ", key).alias("PropostasAlteracao"),
        _few(key % 13 == 0, F.concat(F.lit("anexo-"), ini_id), F.lit("anexo")).alias("IniAnexos"),
        _few(key % 13 == 1, (key - 1).cast("string")).alias("IniciativasOrigem"),
        _few(key % 13 == 2, (key + 1).cast("string"), (key + 2).cast("string")).alias("IniciativasOriginadas"),
        _few(key % 13 == 3, F.concat(F.lit("P-"), ini_id)).alias("Peticoes"),
        F.struct(
            F.when(customer % 10 == 0, "G").when(customer % 10 == 1, "C").alias("sigla"),
            F.when(customer % 10 == 0, "Governo").when(customer % 10 == 1, "Comissões")
            .otherwise("Grupos Parlamentares").alias("nome")
        ).alias("IniAutorOutros"),
        F.transform(authors, lambda gp: F.struct(gp.alias("GP"))).alias("IniAutorGruposParlamentares"),
        F.when(customer % 9 == 4, F.array(signer(customer), signer(customer + 1))).when(customer % 3 != 0, F.array(signer(customer)))
        .alias("IniAutorDeputados"),
        "IniEventos", *[F.when(F.col("Partes") > 1, F.col(c)).alias(c) for c in ("Parte", "Partes")],
    )


# --- activities ---------------------------------------------------------------------------------


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leg, chunk, activity): the rows behind the activity documents."""
    event, user = F.col("event_id"), F.col("user_id")
    kinds = {
        "view": ("VOT", "Voto"), "click": ("MOC", "Moção"), "purchase": ("PRG", "Programa"),
        "signup": ("OEX", "Eleição"), "error": ("SES", "Sessão"),
    }

    def kind(n: int) -> Column:
        out = F.lit(None).cast("string")
        for name, pair in kinds.items():
            out = F.when(F.col("event_type") == name, pair[n]).otherwise(out)
        return out

    def section(title: str, remainder: int) -> Column:
        codes = _tags(parties_where(lambda i: (event + i) % 3 == remainder))
        return F.concat(F.lit(f"{title}: "), F.array_join(codes, ", "))

    day = F.col("ts").cast("date")
    vote = F.struct(
        F.concat(F.lit("av-"), event.cast("string")).alias("id"),
        F.when(event % 13 != 0, F.date_add(day, 1)).alias("data"),
        F.when(event % 17 == 0, None).when(event % 3 == 0, "Rejeitado").otherwise("Aprovado").alias("resultado"),
        _some(event % 20 == 2, "Requerimento ", event % 7).alias("descricao"), _some(event % 20 == 3, event % 30).alias("reuniao"),
        _some(event % 20 == 4, "unanime").alias("unanime"), _few(event % 20 == 5, F.lit("PS"), F.lit("L")).alias("ausencias"),
        F.when(event % 8 == 0, F.concat_ws(
            "<BR>", section("A Favor", 0), section("Contra", 1), section("Abstenção", 2)
        )).alias("detalhe"),
    )
    no_votes = F.array().cast(
        "array<struct<id:string,data:date,resultado:string,descricao:string,reuniao:string,unanime:string,ausencias:array<string>,detalhe:string>>"
    )
    activity = F.struct(
        F.when(event % 20 != 11, F.concat("event_type", F.lit(" "), event.cast("string"))).alias("Assunto"),
        kind(0).alias("Tipo"), kind(1).alias("DescTipo"),
        F.when(event % 4 != 0, event.cast("string")).alias("Numero"),
        F.when(event % 9 != 0, day).alias("DataEntrada"),
        _some(event % 10 == 0, event % 4 + 1).alias("Sessao"), F.when(event % 10 == 1, F.date_add(day, 7)).alias("DataAgendamentoDebate"),
        F.when(event % 10 == 2, F.date_add(day, 1)).alias("DataAnuncio"), _some(user % 10 == 3, "Grupo Parlamentar").alias("TipoAutor"),
        _few(event % 10 == 4, F.concat(F.lit("DAR "), event.cast("string"))).alias("Publicacao"),
        _few(event % 10 == 5, F.concat(F.lit("DAR-D "), event.cast("string")), F.lit("II")).alias("PublicacaoDebate"),
        _some(event % 10 == 6, "Nota ", event).alias("Observacoes"),
        F.when(user % 6 != 0, parties_where(lambda i: (user + i) % 5 == 0)).alias("AutoresGP"),
        F.when(F.col("value") > 10, F.array(vote)).when(event % 2 == 0, no_votes).alias("VotacaoDebate"),
    )
    return table(spark, sf_dir, "events").select(
        legislature_of(user).alias("leg"), _chunk().alias("chunk"), activity.alias("activity")
    )


def _chunk() -> Column:
    """Rows stored side by side: groups of it are bounded whatever the data hold."""
    return F.concat_ws(":", "_metadata.file_name", F.floor(F.col("_metadata.row_index") / ROWS_PER_DOCUMENT))


# --- people and places --------------------------------------------------------------------------


def _legislature_head() -> DataFrame:
    start = F.to_date(F.lit("1995-01-01"))
    number = F.substring("leg", 2, 3).cast("int") - 13
    begins = F.date_add(start, 365 * number)
    sigla = F.lit(None).cast("string")
    for leg, roman in ROMAN.items():
        sigla = F.when(F.col("leg") == leg, roman).otherwise(sigla)
    return F.struct(
        sigla.alias("sigla"), begins.alias("dtini"),
        F.when(F.col("leg") != LEGISLATURES[-1], F.date_add(begins, 364)).alias("dtfim"),
    )


def _deputies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    joined = F.date_add(F.to_date(F.lit("2020-01-01")), (key % 365).cast("int"))

    def membership(index: Column) -> Column:
        return F.array(F.struct(
            _by_index(index).alias("gpSigla"), joined.alias("gpDtInicio"), (index + 1).cast("double").alias("gpId")
        ))

    first, second = membership(key % 10), membership((key + 3) % 10)
    none = F.array().cast("array<struct<gpSigla:string,gpDtInicio:date,gpId:double>>")
    history = F.when(key % 50 == 49, none).when(key % 4 == 0, F.concat(first, second)).otherwise(first)
    states = F.when(key % 3 == 0, _array("Efetivo")).when(key % 3 == 1, _array("Efetivo", "Renunciou")).otherwise(
        _array("Suplente")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", _chunk().alias("chunk"))
    return customers.join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        legislature_of(key).alias("leg"), "chunk",
        F.struct(
            key.cast("double").alias("DepCadId"), F.col("c_name").alias("DepNomeParlamentar"),
            F.concat(F.lit("Nome "), "c_name").alias("DepNomeCompleto"), F.col("n_name").alias("DepCPDes"),
            F.col("c_nationkey").cast("double").alias("DepCPId"), history.alias("DepGP"),
            F.transform(states, lambda s: F.struct(s.alias("sioDes"))).alias("DepSituacao"),
        ).alias("deputy"),
    )


def info_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leg, document): one with circles and parties a legislature, and one a part of its deputies."""
    deputies = _deputies(spark, sf_dir).groupBy("leg", "chunk").agg(F.collect_list("deputy").alias("Deputados"))
    legs = F.explode(F.array(*[F.lit(leg) for leg in LEGISLATURES])).alias("leg")
    nations = table(spark, sf_dir, "nation").select(
        legs, (F.floor(F.col("n_nationkey") / ROWS_PER_DOCUMENT)).alias("chunk"),
        F.struct(F.col("n_nationkey").cast("double").alias("cpId"), F.col("n_name").alias("cpDes")).alias("circle"),
    )
    circles = nations.groupBy("leg", "chunk").agg(F.collect_list("circle").alias("CirculosEleitorais"))
    # The parties of a legislature are all that its deputies sat for at any time: at most a codebook's worth.
    sitting = _deputies(spark, sf_dir).select("leg", F.explode("deputy.DepGP.gpSigla").alias("gp")).distinct()
    groups = sitting.groupBy("leg").agg(F.collect_list(F.struct(
        F.col("gp").alias("sigla"), F.concat(F.lit("Partido "), "gp").alias("nome")
    )).alias("GruposParlamentares"))
    first = F.col("chunk") == 0
    places = circles.join(groups, "leg", "left").withColumn(
        "GruposParlamentares", F.when(first, F.col("GruposParlamentares"))
    ).drop("chunk")
    number = F.regexp_extract("chunk", r":(\d+)$", 1).cast("int") + 1
    both = deputies.withColumn("Parte", number).drop("chunk").unionByName(places.withColumn("Parte", F.lit(0)), allowMissingColumns=True)
    empty = {f: F.coalesce(f, F.array().cast(both.schema[f].dataType))
             for f in ("Deputados", "CirculosEleitorais", "GruposParlamentares")}
    return both.withColumns(empty).withColumn("DetalheLegislatura", _legislature_head())


# --- topics -------------------------------------------------------------------------------------


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in TOPIC_LABELS])
    labels = F.array(*[F.lit(t) for t in TOPIC_LABELS.values()])
    at = (key % len(TOPIC_LABELS) + 1).cast("int")
    dirty = key % 300 == 0
    # No full text, so no topic, for government bills.
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(
        legislature_of(key).alias("leg"), key.cast("string").alias("ini_id"),
        legislature_of(key).alias("legislatura"),
        F.when(dirty, 11).otherwise(F.element_at(codes, at)).alias("cap"),
        F.when(~dirty, F.element_at(labels, at)).alias("cap_label"),
        F.lit("synthetic-v1").alias("model_version"),
    )


# --- bronze files -------------------------------------------------------------------------------


def write_bronze(spark: SparkSession, sf_dir: str, root: str, dataset: str, max_events: int = MAX_EVENTS) -> None:
    """One document a line, packed, in a folder a legislature, in files short enough to be a task each.

    The documents say the same names and phrases over and over: packed they take a tenth of the disk.
    """
    if dataset == "cap":
        records = topics(spark, sf_dir)
    else:
        if dataset == "iniciativas":
            records = initiatives(spark, sf_dir, max_events)
            body = F.to_json(F.array(F.struct(*[c for c in records.columns if c != "leg"])))
        elif dataset == "info_base":
            records = info_base(spark, sf_dir)
            body = F.to_json(F.struct(*[c for c in records.columns if c != "leg"]))
        else:
            records = activities(spark, sf_dir).groupBy("leg", "chunk").agg(F.collect_list("activity").alias("Atividades"))
            body = F.to_json(F.struct(F.struct("Atividades").alias("AtividadesGerais")))
        records = records.select("leg", body.alias("value"))
    writer = records.write.mode("overwrite").partitionBy("leg").options(**PACKED, maxRecordsPerFile=PACKED_RECORDS[dataset])
    with shuffles_removed(spark):
        if dataset == "cap":
            writer.option("header", True).csv(f"{root}/cap")
        else:
            writer.text(f"{root}/{dataset}")
