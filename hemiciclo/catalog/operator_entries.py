"""Projections, filters, unnests, joins, aggregates, orders, set operations and scalar functions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.catalog import flat
from hemiciclo.catalog.registry import big, entry, joined, rows
from hemiciclo.catalog.workspace import Workspace
from hemiciclo.fixtures import initiatives as raw_initiatives
from hemiciclo.functions import columns as fn
from hemiciclo.functions.positions import strip, vote_positions, vote_positions_union
from hemiciclo.operators import predicates as p
from hemiciclo.operators.paging import Key, Listing, ascending, newest_first, total
from hemiciclo.plans import inventory, people, quality, statistics
from hemiciclo.plans.initiatives import (
    AUTHOR_GROUPS, AUTHOR_MEMBERS, events, headers, recent_initiatives, with_matching_event,
)
from hemiciclo.plans.legislatures import dated_legislatures, described_legislatures
from hemiciclo.plans.topics import topics_with_initiative
from hemiciclo.plans.silver import JOBS
from hemiciclo.schemas import ACTIVITY_NAMES, ACTIVITY_RAW, INITIATIVE_NAMES, PART_FIELD
from hemiciclo.sources import readers

LEG = "legislatura"


def count_by(df, *keys, name="n"):
    return df.groupBy(*keys).agg(rows().alias(name))


def raw(w: Workspace, dataset: str):
    return readers.read_documents(w.spark, dataset, w.documents(dataset), multiline=False)


# --- projections --------------------------------------------------------------------------------


@entry("p1_initiative_names", flat.INITIATIVE_SQL.replace("ini_data, ", ""))
def _(w):
    """All 25 columns under their new names, lists as text, the events counted."""
    records = raw(w, "iniciativas")
    sizes = records.groupBy(F.col("IniId").alias("ini_id")).agg(F.sum(F.array_size("IniEventos.EvtId")).alias("n_events"))
    renamed = records.where(F.coalesce(PART_FIELD, F.lit(0)) == 0).select(*fn.rename_to(INITIATIVE_NAMES), LEG)
    return renamed.select(*flat.initiative_columns()).join(sizes, "ini_id")


@entry("p2_activity_names", f"SELECT * EXCLUDE (ativ_id) FROM ({flat.ACTIVITY_SQL})")
def _(w):
    """All 14 columns under their new names, lists and votes as text."""
    names = {n: ACTIVITY_NAMES[n] for n in ACTIVITY_RAW.names}
    return readers.activities_in(raw(w, "atividades")).select(*fn.rename_to(names), LEG).select(LEG, *flat.activity_columns())


@entry("p3_normalized_names", """
    SELECT ini_id, o_custkey AS o_custkey, ini_titulo FROM ini""")
def _(w):
    """Mapped names are looked up, others fall back to lower case."""
    df = w.spark.read.parquet(f"{w.sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("IniId"), F.col("o_custkey").alias("O_CUSTKEY"),
        F.concat(F.lit("Iniciativa "), "o_orderpriority", F.lit(" nº "), "o_orderkey").alias("IniTitulo"),
    )
    return fn.normalize_columns(df)


@entry("p4_constant_columns", """
    SELECT legislatura, 'atividade' AS source, true AS stamped, count(*) AS n FROM avot GROUP BY legislatura""")
def _(w):
    votes = w.table("atividades_votacoes").join(
        w.table("atividades").select("ativ_id", F.col("etl_timestamp").isNotNull().alias("stamped")), "ativ_id"
    )
    return count_by(votes, LEG, "source", "stamped")


@entry("p5_struct_fields", """
    SELECT fase, autor_tipo, count(*) AS n, count(data_fase) AS n_dated
    FROM evt JOIN ini ON l_orderkey = o_orderkey GROUP BY fase, autor_tipo""")
def _(w):
    e = w.table("iniciativas").select(
        F.col("ini_autor_outros.nome").alias("autor_tipo"), F.explode(fn.picked("ini_eventos", "Fase", "DataFase")).alias("e")
    )
    return e.groupBy(F.col("e.Fase").alias("fase"), "autor_tipo").agg(
        rows().alias("n"), F.count("e.DataFase").alias("n_dated")
    )


@entry("p6_list_and_full_record", flat.VOTE_SQL)
def _(w):
    """The full record of each vote: what its list shows and everything else."""
    return w.table("votacoes").select(*flat.vote_columns())


@entry("p7_casts_and_typed_nulls", """
    SELECT CAST(cap AS VARCHAR) AS cap_text, CAST(NULL AS DATE) AS no_day, CAST(NULL AS BIGINT) AS no_number,
      count(*) AS n FROM topic GROUP BY cap""")
def _(w):
    cast = w.table("cap").select(
        F.col("cap").cast("string").alias("cap_text"), F.lit(None).cast("date").alias("no_day"),
        F.lit(None).cast("bigint").alias("no_number"),
    )
    return count_by(cast, "cap_text", "no_day", "no_number")


@entry("p8_field_of_struct_list", """
    SELECT ini_id, CASE WHEN o_custkey % 10 > 0 THEN COALESCE(autor_gp, '') END AS autor_gp
    FROM ini LEFT JOIN authors ON authors.o_orderkey = ini.o_orderkey""")
def _(w):
    return headers(w.table("iniciativas")).select("ini_id", joined(AUTHOR_GROUPS).alias("autor_gp"))


@entry("p9_rebuilt_struct_list", """
    SELECT CAST(c_custkey AS DOUBLE) AS dep_cad_id, n, gp AS gp_sigla, CAST(i + 1 AS DOUBLE) AS gp_id,
      DATE '2020-01-01' + CAST(c_custkey % 365 AS INTEGER) AS gp_dt_inicio FROM dep_gp""")
def _(w):
    h = w.table("deputados").select("dep_cad_id", F.posexplode("partido_historico").alias("at", "h"))
    return h.select(
        "dep_cad_id", (F.col("at") + 1).alias("n"), F.col("h.gp_sigla").alias("gp_sigla"),
        F.col("h.gp_id").alias("gp_id"), F.col("h.gp_dt_inicio").alias("gp_dt_inicio"),
    )


@entry("p10_current_value", "SELECT dep_cad_id, partido_atual, situacao_atual FROM dep")
def _(w):
    return w.table("deputados").select(
        "dep_cad_id", fn.last_of("partido_historico")["gp_sigla"].alias("partido_atual"),
        fn.last_of("situacao_historico")["sio_des"].alias("situacao_atual"),
    )


# --- filters ------------------------------------------------------------------------------------


@entry("f1_optional_equality", "SELECT vot_id, resultado FROM vot WHERE resultado = 'Aprovado'")
def _(w):
    return p.select_where(
        w.table("votacoes"), p.equals("resultado", "Aprovado"), p.equals("fase", None)
    ).select("vot_id", "resultado")


@entry("f2_from_date", "SELECT vot_id, data FROM vot WHERE data >= DATE '1999-01-01'")
def _(w):
    return p.select_where(w.table("votacoes"), p.at_least("data", date(1999, 1, 1))).select("vot_id", "data")


@entry("f3_to_date", "SELECT vot_id, data FROM vot WHERE data <= DATE '1999-01-01'")
def _(w):
    return p.select_where(w.table("votacoes"), p.at_most("data", date(1999, 1, 1))).select("vot_id", "data")


@entry("f4_list_membership", "SELECT vot_id FROM pos WHERE position = 'contra' AND party = 'PS'")
def _(w):
    return p.select_where(w.table("votacoes"), p.holds("detalhe_parsed.contra", "PS")).select("vot_id")


@entry("f5_text_search", "SELECT ini_id, ini_titulo FROM ini WHERE ini_titulo ILIKE '%not_spec%Nº%'")
def _(w):
    found = p.select_where(headers(w.table("iniciativas")), p.contains_text("ini_titulo", "  not_spec%Nº "))
    return found.select("ini_id", "ini_titulo")


@entry("f6_conjunction", """
    SELECT vot_id FROM vot WHERE resultado = 'Rejeitado' AND data >= DATE '1996-06-01' AND fase LIKE 'Vota%'""")
def _(w):
    conditions = [
        p.equals("resultado", "Rejeitado"), p.at_least("data", date(1996, 6, 1)), p.at_most("data", None),
        F.col("fase").like("Vota%"),
    ]
    return p.select_where(w.table("votacoes"), *conditions).select("vot_id")


@entry("f7_author_membership", """
    SELECT ini_id FROM ini WHERE o_orderkey IN (SELECT o_orderkey FROM signer WHERE dep_id = '77')
    UNION ALL SELECT DISTINCT ini_id FROM ini JOIN author ON author.o_orderkey = ini.o_orderkey WHERE gp = 'BE'""")
def _(w):
    heads = headers(w.table("iniciativas"))
    return p.select_where(heads, p.holds(AUTHOR_MEMBERS, "77")).select("ini_id").unionByName(
        p.select_where(heads, p.holds(AUTHOR_GROUPS, "BE")).select("ini_id")
    )


@entry("f8_struct_field_equality", "SELECT ini_id, autor_tipo FROM ini WHERE autor_tipo = 'Governo'")
def _(w):
    found = p.select_where(headers(w.table("iniciativas")), p.equals("ini_autor_outros.nome", "Governo"))
    return found.select("ini_id", F.col("ini_autor_outros.nome").alias("autor_tipo"))


@entry("f9_event_filter", """
    SELECT DISTINCT ini_id, legislatura, ini_data FROM evt JOIN ini ON l_orderkey = o_orderkey
    WHERE data_fase >= DATE '1998-01-01' AND data_fase <= DATE '1998-12-31'
      AND fase IN ('Admissão', 'Votação final global')""")
def _(w):
    return with_matching_event(
        w.table("iniciativas"), date(1998, 1, 1), date(1998, 12, 31), ["Admissão", "Votação final global"]
    ).select("ini_id", LEG, "ini_data")


@entry("f10_comma_list", """
    SELECT evt_id, fase FROM evt JOIN orders ON l_orderkey = o_orderkey WHERE fase IN ('Entrada', 'Admissão')""")
def _(w):
    found = p.select_where(events(w.table("iniciativas"), ["evt_id", "fase"]), p.one_of("fase", p.comma_list(" Entrada, ,Admissão,")))
    return found.select("evt_id", "fase")


@entry("f11_flag_equality", "SELECT vot_id, has_party_details FROM avot WHERE has_party_details")
def _(w):
    return p.select_where(w.table("atividades_votacoes"), p.equals("has_party_details", True)).select(
        "vot_id", "has_party_details"
    )


@entry("f12_null_and_empty_guards", """
    SELECT tipo, has_votes, count(*) AS n FROM ativ GROUP BY tipo, has_votes""")
def _(w):
    return count_by(
        w.table("atividades").select(F.col("ativ_tipo").alias("tipo"), fn.has_items("votacao_debate.id").alias("has_votes")),
        "tipo", "has_votes",
    )


@entry("f13_status_filter", "SELECT dep_cad_id, circulo_id FROM dep WHERE situacao_atual = 'Efetivo'")
def _(w):
    return w.table("deputados").where(F.col("situacao_atual") == people.ACTIVE).select("dep_cad_id", "circulo_id")


@entry("f14_point_lookup", """
    SELECT dep_cad_id, legislatura, nome_completo FROM dep WHERE dep_cad_id = 77 AND legislatura = 'L15'""")
def _(w):
    return people.deputy(w.table("deputados"), 77, "l15").select("dep_cad_id", LEG, "nome_completo")


@entry("f15_code_rules", """
    SELECT upper(p_code) AS code, regexp_full_match(upper(p_code), '[A-Z0-9]{1,10}(-[A-Z0-9]{1,10})?') AS code_valid,
      count(*) AS n FROM (
        SELECT event_type AS p_code FROM events UNION ALL SELECT o_orderpriority FROM orders
        UNION ALL SELECT gp_nome FROM part UNION ALL SELECT lower(gp_sigla) FROM part
      ) GROUP BY ALL""")
def _(w):
    parties = w.table("partidos")
    codes = (
        w.spark.read.parquet(f"{w.sf_dir}/events.parquet").select(F.col("event_type").alias("code"))
        .unionAll(w.spark.read.parquet(f"{w.sf_dir}/orders.parquet").select("o_orderpriority"))
        .unionAll(parties.select("gp_nome")).unionAll(parties.select(F.lower("gp_sigla")))
    )
    return count_by(p.normalize_codes(codes, "code", p.PARTY_PATTERN), "code", "code_valid")


# --- unnest -------------------------------------------------------------------------------------


@entry("u1_unnest_events", """
    SELECT ini_id, ini_nr, legislatura, evt_id, fase, data_fase FROM evt JOIN ini ON l_orderkey = o_orderkey""")
def _(w):
    return events(w.table("iniciativas"), ["evt_id", "fase", "data_fase"]).select(
        "ini_id", "ini_nr", LEG, "evt_id", "fase", "data_fase"
    )


@entry("u2_unnest_votes", "SELECT vot_id, ini_id, fase, data_fase, data, resultado FROM vot")
def _(w):
    from hemiciclo.plans.silver import vote_rows

    return vote_rows(w.table("iniciativas")).select("vot_id", "ini_id", "fase", "data_fase", "data", "resultado")


@entry("u3_unnest_document_collections", """
    SELECT 'deputado' AS kind, legislatura, nome_parlamentar AS name FROM dep
    UNION ALL SELECT 'circulo', legislatura, cp_des FROM circ
    UNION ALL SELECT 'partido', legislatura, gp_sigla FROM part""")
def _(w):
    from hemiciclo.plans.silver import circles, deputies, parties

    base = w.table("info_base")
    parts = {
        "deputado": deputies(base).select(LEG, F.col("nome_parlamentar").alias("name")),
        "circulo": circles(base).select(LEG, F.col("cp_des").alias("name")),
        "partido": parties(base).select(LEG, F.col("gp_sigla").alias("name")),
    }
    return readers.union_drifting(*[df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()])


@entry("u4_unnest_authors", """
    SELECT ini_id, gp AS party FROM author JOIN ini ON author.o_orderkey = ini.o_orderkey""")
def _(w):
    return headers(w.table("iniciativas")).select("ini_id", F.explode(AUTHOR_GROUPS).alias("party"))


@entry("u5_unpivot_positions", """
    SELECT legislatura, fase, position, party, count(*) AS n FROM pos GROUP BY legislatura, fase, position, party""")
def _(w):
    return count_by(vote_positions(w.table("votacoes"), [LEG, "fase"]), LEG, "fase", "position", "party")


# --- joins --------------------------------------------------------------------------------------


@entry("j1_votes_by_author", """
    SELECT gp AS party, resultado, count(*) AS n, count(DISTINCT vot.ini_id) AS n_initiatives
    FROM author JOIN vot ON author.o_orderkey = vot.o_orderkey GROUP BY gp, resultado""")
def _(w):
    """Votes meet the authors of their initiatives where they are stored: each vote has the list."""
    votes = w.table("votacoes").select("ini_id", "resultado", F.explode("ini_autores_gp").alias("party"))
    return votes.groupBy("party", "resultado").agg(
        rows().alias("n"), F.countDistinct("ini_id").alias("n_initiatives")
    )


@entry("j2_semi_join", """
    SELECT vot_id FROM vot WHERE o_orderkey IN (SELECT o_orderkey FROM author WHERE gp = 'PCP')""")
def _(w):
    ids = headers(w.table("iniciativas")).where(F.array_contains(AUTHOR_GROUPS, "PCP")).select(LEG, "ini_id")
    return w.table("votacoes").join(ids, [LEG, "ini_id"], "left_semi").select("vot_id")


@entry("j3_topics_with_initiatives", """
    SELECT topic.ini_id, cap, cap_label, ini_tipo, ini_titulo, ini_data
    FROM topic JOIN ini ON topic.o_orderkey = ini.o_orderkey WHERE ini_tipo = 'J'""")
def _(w):
    bills = headers(w.table("iniciativas")).where(F.col("ini_tipo") == "J")
    return topics_with_initiative(w.table("cap"), bills).select(
        "ini_id", "cap", "cap_label", "ini_tipo", "ini_titulo", "ini_data"
    )


@entry("j4_outer_attach", """
    WITH done AS (
      SELECT autor_tipo, legislatura, count(*) AS n_votes FROM vot JOIN ini USING (o_orderkey, legislatura)
      WHERE fase = 'Votação final global' AND autor_tipo <> 'Governo' GROUP BY 1, 2
    )
    SELECT i.legislatura, i.autor_tipo, count(*) AS n_initiatives, max(COALESCE(n_votes, 0)) AS n_votes
    FROM ini i LEFT JOIN done ON done.legislatura = i.legislatura AND done.autor_tipo = i.autor_tipo
    GROUP BY i.legislatura, i.autor_tipo""")
def _(w):
    """Totals keep their row where there is nothing to attach."""
    heads = headers(w.table("iniciativas")).select(LEG, "ini_id", F.col("ini_autor_outros.nome").alias("autor_tipo"))
    final = w.table("votacoes").where(F.col("fase") == "Votação final global").select(LEG, "ini_id")
    done = final.join(heads.where(F.col("autor_tipo") != "Governo"), [LEG, "ini_id"])
    totals = count_by(heads, LEG, "autor_tipo", name="n_initiatives")
    return totals.join(count_by(done, LEG, "autor_tipo", name="n_votes"), [LEG, "autor_tipo"], "left").withColumn(
        "n_votes", F.coalesce("n_votes", F.lit(0))
    )


@entry("j5_existence_gate", """
    SELECT dep_cad_id, dep.legislatura, partido_atual FROM dep
    JOIN part ON part.legislatura = dep.legislatura AND gp_sigla = partido_atual""")
def _(w):
    on = {LEG: LEG, "partido_atual": "gp_sigla"}
    known = people.children_of_known(w.table("deputados"), w.table("partidos"), on)
    return known.select("dep_cad_id", LEG, "partido_atual")


@entry("j6_parent_attributes", """
    SELECT evt_id, ini_nr, legislatura, ini_titulo, ini_tipo FROM evt JOIN ini ON l_orderkey = o_orderkey""")
def _(w):
    return events(w.table("iniciativas"), ["evt_id"]).select("evt_id", "ini_nr", LEG, "ini_titulo", "ini_tipo")


# --- aggregates ---------------------------------------------------------------------------------


@entry("a1_count_by_two_keys", """
    SELECT fase, resultado, count(*) AS n FROM vot WHERE fase IS NOT NULL AND resultado IS NOT NULL
    GROUP BY fase, resultado""")
def _(w):
    return count_by(w.table("votacoes").dropna(subset=["fase", "resultado"]), "fase", "resultado")


@entry("a2_distinct_count", """
    SELECT fase, count(*) AS n, count(DISTINCT ini_id) AS n_initiatives FROM vot GROUP BY fase""")
def _(w):
    return w.table("votacoes").groupBy("fase").agg(rows().alias("n"), F.countDistinct("ini_id").alias("n_initiatives"))


@entry("a3_count_by_key", "SELECT ativ_tipo, n FROM (SELECT tipo AS ativ_tipo, count(*) AS n FROM ativ GROUP BY 1)")
def _(w):
    return count_by(w.table("atividades"), "ativ_tipo")


@entry("a4_count_by_three_keys", """
    SELECT gp AS party, fase, resultado, count(*) AS vote_count FROM author
    JOIN vot ON author.o_orderkey = vot.o_orderkey WHERE fase IS NOT NULL AND resultado IS NOT NULL
    GROUP BY gp, fase, resultado""")
def _(w):
    out = statistics.party_outcomes(w.table("votacoes"))
    return out.groupBy("party", "fase", "resultado").agg(F.sum("vote_count").alias("vote_count"))


@entry("a5_position_pivot", """
    SELECT fase, party, count(*) FILTER (position = 'a_favor') AS a_favor, count(*) FILTER (position = 'contra') AS contra,
      count(*) FILTER (position = 'abstencao') AS abstencao
    FROM pos WHERE position <> 'ausencia' GROUP BY fase, party""")
def _(w):
    cast_votes = vote_positions(w.table("votacoes"), ["fase"], statistics.VOTED)
    return cast_votes.groupBy("fase", "party").pivot("position", list(statistics.VOTED)).count().na.fill(0)


@entry("a6_filtered_total", "SELECT count(*) AS total FROM vot WHERE resultado = 'Aprovado' AND data <= DATE '1997-06-30'")
def _(w):
    return total(p.select_where(
        w.table("votacoes"), p.equals("resultado", "Aprovado"), p.at_most("data", date(1997, 6, 30))
    ))


@entry("a7_distinct_parents", """
    SELECT count(DISTINCT l_orderkey) AS total FROM evt JOIN orders ON l_orderkey = o_orderkey
    WHERE fase = 'Entrada' AND data_fase >= DATE '1997-01-01'""")
def _(w):
    return total(with_matching_event(w.table("iniciativas"), date(1997, 1, 1), phases=["Entrada"]))


@entry("a8_min_by_group", "SELECT legislatura, min(data_inicio_leg) AS dtini FROM ini GROUP BY legislatura")
def _(w):
    return dated_legislatures(w.table("iniciativas")).select(LEG, "dtini")


@entry("a9_side_by_side_totals", """
    SELECT iniciativas, atividades, iniciativas + atividades AS total FROM (
      SELECT (SELECT count(*) FROM vot WHERE legislatura = 'L16') AS iniciativas,
        (SELECT count(*) FROM avot WHERE legislatura = 'L16') AS atividades)""")
def _(w):
    return statistics.vote_sources(w.table("votacoes"), w.table("atividades_votacoes"), "L16").drop(LEG)


@entry("a10_nested_children", """
    SELECT fase, resultado, vote_count, gp AS party FROM (
      SELECT gp, fase, resultado, count(*) AS vote_count FROM author JOIN vot ON author.o_orderkey = vot.o_orderkey
      WHERE fase IS NOT NULL AND resultado IS NOT NULL GROUP BY gp, fase, resultado)""")
def _(w):
    outcomes = statistics.party_outcomes(w.table("votacoes")).groupBy(
        "party", "fase", "resultado").agg(F.sum("vote_count").alias("vote_count"))
    nested = outcomes.groupBy("party").agg(
        F.sort_array(F.collect_list(F.struct("fase", "resultado", "vote_count"))).alias("outcomes")
    )
    return nested.select("party", F.inline("outcomes"))


@entry("a11_distinct", """
    SELECT DISTINCT legislatura, ini_tipo, autor_gp FROM ini LEFT JOIN authors ON authors.o_orderkey = ini.o_orderkey""")
def _(w):
    authors = F.array_sort(F.col(AUTHOR_GROUPS)).alias("authors")
    unique = headers(w.table("iniciativas")).select(LEG, "ini_tipo", authors).distinct()
    return unique.select(
        LEG, "ini_tipo", F.when(F.array_size("authors") > 0, F.array_join("authors", "|")).alias("autor_gp")
    ).distinct()


@entry("a12_dataset_counts", """
    SELECT 'iniciativas' AS dataset, count(*) AS n_rows, true AS available FROM ini
    UNION ALL SELECT 'deputados', count(*), true FROM dep UNION ALL SELECT 'circulos', count(*), true FROM circ
    UNION ALL SELECT 'partidos', count(*), true FROM part UNION ALL SELECT 'votacoes', count(*), true FROM vot
    UNION ALL SELECT 'info_base', count(*), true FROM base UNION ALL SELECT 'atividades', count(*), true FROM act
    UNION ALL SELECT 'atividades_votacoes', count(*), true FROM avot UNION ALL SELECT 'cap', count(*), true FROM topic""")
def _(w):
    names = list(JOBS)
    w.build(*names)
    return inventory.inventory(w.spark, w.silver, names).select("dataset", "n_rows", "available")


@entry("a13_list_sizes", """
    SELECT d.legislatura, num_deputados, num_grupos FROM
      (SELECT legislatura, count(*) AS num_deputados FROM dep GROUP BY 1) d
      JOIN (SELECT legislatura, count(*) AS num_grupos FROM part GROUP BY 1) g ON g.legislatura = d.legislatura""")
def _(w):
    return described_legislatures(w.table("info_base")).select(LEG, "num_deputados", "num_grupos")


# --- orders and pages ---------------------------------------------------------------------------


@entry("o1_newest_first", """
    SELECT ini_id, ini_data, (SELECT count(*) FROM ini) AS total FROM ini
    ORDER BY ini_data DESC NULLS LAST, ini_id DESC LIMIT 100""")
def _(w):
    return Listing(
        headers(w.table("iniciativas")), recent_initiatives(), ["ini_id", "ini_data"], limit=100
    ).page_with_total()


@entry("o2_order_over_a_join", """
    SELECT topic.legislatura, topic.ini_id, cap, ini_data FROM topic JOIN ini ON topic.o_orderkey = ini.o_orderkey
    ORDER BY topic.legislatura DESC, ini_data DESC NULLS LAST, topic.ini_id DESC LIMIT 500""")
def _(w):
    rows = topics_with_initiative(w.table("cap"), headers(w.table("iniciativas")))
    order = [Key(c, descending=True) for c in (LEG, "ini_data", "ini_id")]
    return Listing(rows, order, [LEG, "ini_id", "cap", "ini_data"], limit=500).page


@entry("o3_page", """
    SELECT vot_id, data, (SELECT count(*) FROM vot) AS total FROM vot
    ORDER BY data DESC NULLS LAST, vot_id LIMIT 50 OFFSET 1200""")
def _(w):
    order = newest_first("data", Key("vot_id"))
    return Listing(w.table("votacoes"), order, ["vot_id", "data"], limit=50, offset=1200).page_with_total()


@entry("o4_ascending_nulls_last", """
    SELECT evt_id, data_fase, fase FROM evt JOIN orders ON l_orderkey = o_orderkey
    ORDER BY fase NULLS LAST, data_fase NULLS LAST, evt_id LIMIT 500""")
def _(w):
    return Listing(
        events(w.table("iniciativas"), ["evt_id", "fase", "data_fase"]), ascending("fase", "data_fase", "evt_id"),
        ["evt_id", "data_fase", "fase"], limit=500,
    ).page


@entry("o5_ranked_groups", """
    SELECT legislatura, autor_tipo, count(*) AS n FROM ini GROUP BY 1, 2 ORDER BY n DESC, legislatura, autor_tipo LIMIT 10""")
def _(w):
    groups = count_by(headers(w.table("iniciativas")), LEG, F.col("ini_autor_outros.nome").alias("autor_tipo"))
    return groups.orderBy(F.col("n").desc(), LEG, "autor_tipo").limit(10)


@entry("o6_number_as_text", """
    SELECT ini_nr, ini_id FROM ini ORDER BY ini_nr DESC, ini_id LIMIT 500""")
def _(w):
    order = [Key("ini_nr", descending=True), Key("ini_id")]
    return Listing(headers(w.table("iniciativas")), order, ["ini_nr", "ini_id"], limit=500).page


# --- set operations -----------------------------------------------------------------------------


@entry("x1_union_of_unnests", """
    SELECT legislatura, position, party, count(*) AS n FROM pos WHERE position <> 'ausencia'
    GROUP BY legislatura, position, party""")
def _(w):
    return count_by(
        vote_positions_union(w.table("votacoes"), [LEG], statistics.VOTED), LEG, "position", "party"
    )


@entry("x2_union_by_name", """
    SELECT legislatura, resultado, tipo_reuniao, tipo, count(*) AS n FROM (
      SELECT legislatura, resultado, tipo_reuniao, CAST(NULL AS VARCHAR) AS tipo FROM vot
      UNION ALL SELECT legislatura, resultado, NULL, tipo FROM avot) GROUP BY ALL""")
def _(w):
    """Votes of both kinds in one table; a column only one kind has is NULL for the other."""
    both = readers.union_drifting(
        w.table("votacoes").select(LEG, "resultado", "tipo_reuniao"),
        w.table("atividades_votacoes").select("tipo", LEG, "resultado"),
    )
    return count_by(both, LEG, "resultado", "tipo_reuniao", "tipo")


# --- scalar functions ---------------------------------------------------------------------------


@entry("c1_nominal_flag", "SELECT vot_id, is_nominal FROM vot")
def _(w):
    return w.table("votacoes").select("vot_id", fn.is_nominal(F.col("detalhe")).alias("is_nominal"))


@entry("c2_text_flag", "SELECT vot_id, has_party_details FROM avot")
def _(w):
    return w.table("atividades_votacoes").select("vot_id", fn.has_text("detalhe").alias("has_party_details"))


@entry("c3_list_flag", "SELECT ativ_id, has_votes FROM act")
def _(w):
    return w.table("atividades").select("ativ_id", fn.has_items("votacao_debate.id").alias("has_votes"))


@entry("c4_first_date", "SELECT ini_id, ini_data FROM ini")
def _(w):
    """On the raw records, parts of one initiative together."""
    records = raw_initiatives(w.spark, w.sf_dir).select(
        F.col("IniId").alias("ini_id"), fn.first_date("IniEventos", "DataFase").alias("ini_data"), "Parte"
    )
    return records.where(F.coalesce("Parte", F.lit(0)) == 0).select("ini_id", "ini_data")


@entry("c5_coalesce", "SELECT ativ_id, COALESCE(assunto, desc_tipo) AS shown FROM act")
def _(w):
    return w.table("atividades").select("ativ_id", F.coalesce("ativ_assunto", "ativ_desc_tipo").alias("shown"))


@entry("c6_list_length", """
    SELECT event_id, CASE WHEN user_id % 6 <> 0 THEN n END AS n_authors FROM (
      SELECT e.event_id, e.user_id, count(gp) AS n FROM ativ e LEFT JOIN act_author a ON a.event_id = e.event_id
      GROUP BY e.event_id, e.user_id)""")
def _(w):
    number = F.when(F.col("ativ_numero").isNotNull(), F.col("ativ_numero").cast("bigint"))
    ids = F.coalesce(number, F.regexp_extract("ativ_assunto", r"(\d+)$", 1).try_cast("bigint"), F.regexp_extract(
        F.get("votacao_debate", F.lit(0))["id"], r"(\d+)$", 1).try_cast("bigint"))
    return w.table("atividades").select(ids.alias("event_id"), big(F.array_size("ativ_autores_gp")).alias("n_authors"))


@entry("c7_synthetic_key", "SELECT ativ_id, legislatura, tipo, numero FROM act")
def _(w):
    a = readers.activities_in(raw(w, "atividades"))
    key = fn.activity_key(F.col(LEG), F.col("Tipo"), F.col("Numero"), F.col("Assunto"), F.col("DataEntrada"))
    return a.select(key.alias("ativ_id"), LEG, F.col("Tipo").alias("tipo"), F.col("Numero").alias("numero"))


@entry("c8_case", """
    SELECT CASE WHEN resultado = 'Aprovado' THEN 1 WHEN resultado = 'Rejeitado' THEN -1 ELSE 0 END AS outcome,
      count(*) AS n FROM vot GROUP BY 1""")
def _(w):
    outcome = F.when(F.col("resultado") == "Aprovado", 1).when(F.col("resultado") == "Rejeitado", -1).otherwise(0)
    return count_by(w.table("votacoes"), outcome.alias("outcome"))


@entry("c9_case_insensitive_match", "SELECT ini_desc_tipo, count(*) AS n FROM ini WHERE ini_desc_tipo ILIKE '%RESOLUÇÃO%' GROUP BY 1")
def _(w):
    found = headers(w.table("iniciativas")).where(F.col("ini_desc_tipo").ilike("%RESOLUÇÃO%"))
    return count_by(found, "ini_desc_tipo")


@entry("c10_load_time", """
    SELECT legislatura, count(*) AS n, CAST(1 AS BIGINT) AS n_loads, CASE WHEN count(*) FILTER (ini_nr = '77') > 0
      AND count(*) FILTER (ini_nr <> '77') > 0 THEN 2 ELSE 1 END::BIGINT AS n_seeded FROM ini GROUP BY legislatura""")
def _(w):
    """A job stamps all rows of a legislature with one time; rows of another load show, as those put in do."""
    later = F.when(F.col("ini_nr") == "77", F.col("etl_timestamp") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("etl_timestamp"))
    return headers(w.table("iniciativas")).groupBy(LEG).agg(
        rows().alias("n"), F.countDistinct("etl_timestamp").alias("n_loads"), F.countDistinct(later).alias("n_seeded")
    )


@entry("c11_list_functions", """
    SELECT evt_id, fase = 'Entrada' AS is_entry, l_suppkey % 20 = 5 AS has_annex FROM evt
    JOIN orders ON l_orderkey = o_orderkey""")
def _(w):
    """transform to a list of structs, a lambda over it, membership; of the events only what is asked for is read."""
    flags = F.transform(fn.picked("ini_eventos", "EvtId", "Fase", "AnexosFase"), lambda e: F.struct(
        e["EvtId"].alias("evt_id"), F.array_contains(F.array(e["Fase"]), "Entrada").alias("is_entry"),
        F.coalesce(F.array_size(e["AnexosFase"]) > 0, F.lit(False)).alias("has_annex"),
    ))
    return w.table("iniciativas").select(F.inline(flags))


@entry("c12_last_element", """
    SELECT legislatura, situacao_atual, partido_atual, count(*) AS n FROM dep GROUP BY ALL""")
def _(w):
    return count_by(
        w.table("deputados").select(
            LEG, fn.last_of("situacao_historico.sio_des").alias("situacao_atual"),
            fn.last_of("partido_historico.gp_sigla").alias("partido_atual"),
        ), LEG, "situacao_atual", "partido_atual",
    )


@entry("c13_text_functions", """
    SELECT ini_id, lower(o_part) AS part, contains(ini_titulo, 'URGENT') AS urgent,
      regexp_replace(ini_titulo, '[0-9]+', '#', 'g') AS masked FROM (
        SELECT *, trim(string_split(ini_titulo, 'nº')[1]) AS o_part FROM ini)""")
def _(w):
    title = F.col("ini_titulo")
    return headers(w.table("iniciativas")).select(
        "ini_id", F.lower(strip(F.split(title, "nº")[0])).alias("part"), title.rlike("URGENT").alias("urgent"),
        F.regexp_replace(title, "[0-9]+", "#").alias("masked"),
    )


@entry("c14_upper_codes", """
    SELECT upper(gp_sigla) AS gp_sigla, upper(gp_nome) AS gp_nome, legislatura FROM part""")
def _(w):
    return w.table("partidos").select(F.upper("gp_sigla").alias("gp_sigla"), F.upper("gp_nome").alias("gp_nome"), LEG)


@entry("n1_parse_positions", "SELECT vot_id, position, party FROM pos")
def _(w):
    from hemiciclo.functions.positions import parse_positions

    parsed = parse_positions(w.table("votacoes").select("vot_id", "detalhe"))
    return vote_positions(parsed, ["vot_id"])


# --- data quality: what a rule finds, or where it finds nothing how much it looked at -------------


def verdict_sql(checked: str, bad: str) -> str:
    return f"SELECT (SELECT count(*) FROM {checked}) AS n_checked, (SELECT count(*) FROM ({bad})) AS n_bad"


@entry("d1_duplicate_initiatives", verdict_sql("ini", "SELECT ini_id FROM ini GROUP BY ini_id HAVING count(*) > 1"))
def _(w):
    table = w.table("iniciativas")
    return quality.verdict(headers(table), quality.duplicate_initiatives(table))


@entry("d2_number_collisions", """
    SELECT legislatura, ini_nr, count(*) AS n FROM ini GROUP BY legislatura, ini_nr HAVING count(*) > 1""")
def _(w):
    return quality.number_collisions(w.table("iniciativas"))


@entry("d3_circle_counts", """
    SELECT legislatura, count(*) AS n, CAST(22 AS BIGINT) AS expected FROM circ GROUP BY legislatura HAVING count(*) <> 22""")
def _(w):
    return quality.wrong_counts(w.table("circulos"), 22)


@entry("d4_party_counts", """
    SELECT legislatura, count(*) AS n, CAST(e AS BIGINT) AS expected FROM part
    JOIN (VALUES ('L13', 3), ('L14', 2), ('L15', 3), ('L16', 3), ('L17', 4)) v(leg, e) ON leg = legislatura
    GROUP BY legislatura, e HAVING count(*) <> e""")
def _(w):
    """L14 and L17 are expected wrongly, to show what the check reports."""
    return quality.wrong_counts(w.table("partidos"), {"L13": 3, "L14": 2, "L15": 3, "L16": 3, "L17": 4})


@entry("d5_independent_names", verdict_sql(
    "pos", r"SELECT party FROM pos WHERE contains(party, 'Ninsc') AND NOT regexp_matches(party, '^\S.* \(Ninsc\)$')"
))
def _(w):
    votes = w.table("votacoes")
    return quality.verdict_of_rows(vote_positions(votes, ["vot_id"]), quality.is_malformed_independent())


@entry("d6_detail_flags", verdict_sql(
    "avot", "SELECT vot_id FROM avot WHERE has_party_details <> (vot_id IN (SELECT vot_id FROM apos))"
))
def _(w):
    table = w.table("atividades_votacoes")
    return quality.verdict_of_rows(table, quality.has_wrong_detail_flag())


@entry("d7_source_totals", """
    WITH counted AS (SELECT legislatura, count(*) AS counted FROM
        (SELECT legislatura FROM vot UNION ALL SELECT legislatura FROM avot) GROUP BY 1),
      seeded AS (SELECT legislatura, count(*) AS total FROM (
        SELECT legislatura FROM vot WHERE NOT (reuniao = '5' AND legislatura IN ('L14', 'L16'))
        UNION ALL SELECT legislatura FROM avot) GROUP BY 1)
    SELECT 'as reported' AS kind, (SELECT sum(counted)::BIGINT FROM counted) AS n_checked, CAST(0 AS BIGINT) AS n_bad
    UNION ALL SELECT 'votes left out', (SELECT sum(counted)::BIGINT FROM counted), (SELECT count(*) FROM counted
      LEFT JOIN seeded ON seeded.legislatura = counted.legislatura WHERE total IS DISTINCT FROM counted)""")
def _(w):
    """Once as the report is, and once over votes of which a part is left out in two legislatures."""
    votes, others = w.table("votacoes"), w.table("atividades_votacoes")
    both = votes.select(LEG).unionByName(others.select(LEG))
    partial = votes.where(~((F.col("reuniao") == "5") & F.col(LEG).isin("L14", "L16")))
    reported = {"as reported": statistics.vote_sources(votes, others), "votes left out": statistics.vote_sources(partial, others)}
    return reduce(DataFrame.unionByName, [
        quality.verdict(both, quality.source_total_mismatches(votes, others, report)).withColumn("kind", F.lit(kind))
        for kind, report in reported.items()
    ])


@entry("d8_activity_keys", verdict_sql("act", """
    SELECT ativ_id FROM act
    WHERE NOT (starts_with(ativ_id, legislatura || '_') AND length(ativ_id) > length(legislatura) + 1)"""))
def _(w):
    table = w.table("atividades")
    return quality.verdict_of_rows(table, quality.is_bad_activity_key())


@entry("d9_topic_codebook", """
    SELECT ini_id, cap, cap_label FROM topic
    WHERE NOT EXISTS (SELECT 1 FROM book WHERE code = topic.cap AND label = topic.cap_label)""")
def _(w):
    return quality.bad_topics(w.table("cap"))


@entry("d10_output_contract", """
    SELECT 'cap' AS dataset, 'cap_label' AS "column", 'null' AS problem, count(*) AS n FROM topic
    WHERE cap_label IS NULL HAVING count(*) > 0""")
def _(w):
    return quality.contract_report({n: w.table(n) for n in JOBS})


@entry("d11_over_classified", verdict_sql("topic", """
    SELECT t.legislatura FROM
      (SELECT legislatura, count(*) AS n_topics FROM topic GROUP BY 1) t
      JOIN (SELECT legislatura, count(*) AS n_initiatives FROM ini GROUP BY 1) i ON i.legislatura = t.legislatura
    WHERE n_topics > n_initiatives"""))
def _(w):
    topics = w.table("cap")
    return quality.verdict(topics, quality.over_classified(topics, w.table("iniciativas")))


@entry("d12_disjoint_pages", """
    WITH hit AS (SELECT vot_id, data, row_number() OVER (ORDER BY data DESC NULLS LAST, vot_id DESC) AS n
      FROM vot WHERE data >= DATE '1996-01-01')
    SELECT 'as listed' AS kind, count(*) AS n_checked, CAST(0 AS BIGINT) AS n_bad FROM hit
    UNION ALL SELECT 'overlapping', count(*), count(*) FILTER (n BETWEEN 494 AND 500) FROM hit
    UNION ALL SELECT 'later bound', count(*), count(*) FILTER (n <= 1000 AND data > DATE '1998-09-01') FROM hit""")
def _(w):
    """Once as pages are, once with pages that share seven rows, once with a bound that some rows exceed."""
    from hemiciclo.plans.votes import list_votes

    votes, since = w.table("votacoes"), date(1996, 1, 1)
    listing = list_votes(votes, data_desde=since, limit=500)
    first, second = quality.pages(listing, 2)
    both = first.page.unionByName(second.page)
    overlapping = list_votes(votes, data_desde=since, limit=500, offset=493)
    bad = {
        "as listed": quality.repeated_rows(first, second, "vot_id").unionByName(quality.out_of_bounds(both, "data", since).select("vot_id")),
        "overlapping": quality.repeated_rows(first, overlapping, "vot_id"),
        "later bound": quality.out_of_bounds(both, "data", since, date(1998, 9, 1)).select("vot_id"),
    }
    return reduce(DataFrame.unionByName, [quality.verdict(listing.rows, rows).withColumn("kind", F.lit(kind)) for kind, rows in bad.items()])


@entry("d13_active_deputies_and_source", """
    SELECT 'deputado' AS kind, count(*) AS n_checked, CAST(0 AS BIGINT) AS n_bad FROM dep WHERE situacao_atual = 'Efetivo'
    UNION ALL SELECT 'deputado de qualquer estado', count(*), count(*) FILTER (situacao_atual <> 'Efetivo') FROM dep
    UNION ALL SELECT 'voto', count(*), 0 FROM avot
    UNION ALL SELECT 'voto de outra fonte', count(*), count(*) FILTER (tipo = 'MOC') FROM avot""")
def _(w):
    """The listings of all circles of all legislatures, and the same rules where they must find something."""
    circles, deputies, votes = w.table("circulos"), w.table("deputados"), w.table("atividades_votacoes")
    other = votes.withColumn("source", F.when(F.col("tipo") == "MOC", "iniciativa").otherwise(F.col("source")))
    checked = {
        "deputado": (people.sitting_deputies(circles, deputies), quality.is_inactive()),
        "deputado de qualquer estado": (people.deputies_of_circles(circles, deputies), quality.is_inactive()),
        "voto": (votes, quality.has_wrong_source()), "voto de outra fonte": (other, quality.has_wrong_source()),
    }
    return reduce(DataFrame.unionByName, [
        quality.verdict_of_rows(rows, rule).withColumn("kind", F.lit(kind)) for kind, (rows, rule) in checked.items()
    ])
