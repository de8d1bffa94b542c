"""The public queries and reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hemiciclo.catalog import flat
from hemiciclo.catalog.registry import big, entry, joined
from hemiciclo.plans import (
    activities, initiatives, inventory, legislatures, people, statistics, topics, votes,
)

LEG = "legislatura"


def listed(listing, *lists: str):
    """A page with its total, list columns as text."""
    return listing.page_with_total().withColumns({c: joined(c) for c in lists})


# --- initiatives --------------------------------------------------------------------------------


@entry("q1_initiatives", """
    WITH hit AS (
      SELECT ini.*, autor_gp FROM ini LEFT JOIN authors ON authors.o_orderkey = ini.o_orderkey
      WHERE legislatura = 'L17' AND ini_tipo = 'J' AND ini_titulo ILIKE '%high%'
        AND ini.o_orderkey IN (SELECT o_orderkey FROM author WHERE gp = 'PS')
        AND ini.o_orderkey IN (SELECT l_orderkey FROM evt WHERE fase IN ('Entrada', 'Votação final global')
          AND data_fase BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')
    )
    SELECT ini_id, ini_nr, legislatura, ini_tipo, ini_desc_tipo, ini_titulo, autor_gp, (SELECT count(*) FROM hit) AS total
    FROM hit ORDER BY ini_data DESC NULLS LAST, ini_id DESC LIMIT 50""")
def _(w):
    return listed(initiatives.list_initiatives(
        w.table("iniciativas"), legislatura="l17", tipo="J", q="high", autor_gp="ps",
        data_desde=date(1996, 1, 1), data_ate=date(2000, 12, 31), evento_fase="Entrada, Votação final global",
    ), "autor_gp")


@entry("q1_initiatives_unfiltered", """
    SELECT ini_id, ini_nr, legislatura, ini_tipo, ini_desc_tipo, ini_titulo,
      CASE WHEN o_custkey % 10 > 0 THEN COALESCE(autor_gp, '') END AS autor_gp, (SELECT count(*) FROM ini) AS total
    FROM ini LEFT JOIN authors ON authors.o_orderkey = ini.o_orderkey
    ORDER BY ini_data DESC NULLS LAST, ini_id DESC LIMIT 500 OFFSET 500""")
def _(w):
    return listed(initiatives.list_initiatives(w.table("iniciativas"), limit=500, offset=500), "autor_gp")


@entry("q1_initiatives_by_author", """
    WITH hit AS (SELECT * FROM ini WHERE autor_tipo = 'Grupos Parlamentares'
      AND o_orderkey IN (SELECT o_orderkey FROM signer WHERE dep_id = '77'))
    SELECT ini_id, ini_nr, legislatura, ini_tipo, ini_desc_tipo, ini_titulo, autor_gp, (SELECT count(*) FROM hit) AS total
    FROM hit LEFT JOIN authors ON authors.o_orderkey = hit.o_orderkey
    ORDER BY ini_data DESC NULLS LAST, ini_id DESC LIMIT 50""")
def _(w):
    return listed(initiatives.list_initiatives(
        w.table("iniciativas"), autor_tipo="Grupos Parlamentares", dep_cad_id="77"
    ), "autor_gp")


@entry("q2_initiative_record", f"{flat.INITIATIVE_RECORD_SQL} WHERE ini_id = '77'")
def _(w):
    """The nested record of one id, every field of it, its events and their votes laid out."""
    return flat.initiative_record(initiatives.initiative(w.table("iniciativas"), "77"))


@entry("q3_initiative_events", f"""
    WITH hit AS (SELECT ini_id, ini_nr, legislatura, ini_titulo, ini_tipo, e.* EXCLUDE (l_orderkey) FROM ini JOIN ({flat.EVENT_SQL}) e
      ON e.l_orderkey = o_orderkey WHERE ini_id = '77' AND data_fase >= DATE '1995-06-01' AND data_fase <= DATE '2001-06-01')
    SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY data_fase NULLS LAST, evt_id LIMIT 50""")
def _(w):
    """All 13 columns of the events, beside those of the initiative."""
    page = initiatives.list_events(
        w.table("iniciativas"), "77", data_desde=date(1995, 6, 1), data_ate=date(2001, 6, 1)
    ).page_with_total()
    return page.select("ini_id", "ini_nr", LEG, "ini_titulo", "ini_tipo", *flat.event_columns(), "total")


# --- votes --------------------------------------------------------------------------------------


@entry("q4_votes", """
    WITH hit AS (SELECT * FROM vot WHERE legislatura = 'L16' AND resultado = 'Aprovado' AND ini_titulo ILIKE '%medium%'
      AND data BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
      AND vot_id IN (SELECT vot_id FROM pos WHERE position = 'a_favor' AND party = 'PS')
      AND vot_id IN (SELECT vot_id FROM pos WHERE position = 'contra' AND party = 'PSD')
      AND vot_id IN (SELECT vot_id FROM pos WHERE position = 'abstencao' AND party = 'CH'))
    SELECT vot_id, ini_nr, legislatura, ini_titulo, fase, data, resultado, (SELECT count(*) FROM hit) AS total
    FROM hit ORDER BY data DESC NULLS LAST, vot_id DESC LIMIT 500""")
def _(w):
    return votes.list_votes(
        w.table("votacoes"), legislatura="L16", resultado="Aprovado", q="medium", data_desde=date(1996, 1, 1),
        data_ate=date(1999, 12, 31), partido_favor="ps", partido_contra="psd", partido_abstencao="ch", limit=500,
    ).page_with_total()


@entry("q4_votes_unfiltered", """
    SELECT vot_id, ini_nr, legislatura, ini_titulo, fase, data, resultado, (SELECT count(*) FROM vot) AS total
    FROM vot ORDER BY data DESC NULLS LAST, vot_id DESC LIMIT 500 OFFSET 1000""")
def _(w):
    return votes.list_votes(w.table("votacoes"), limit=500, offset=1000).page_with_total()


@entry("q4_votes_of_party", """
    WITH hit AS (SELECT vot.* FROM vot JOIN pos ON pos.vot_id = vot.vot_id AND position = 'contra' AND party = 'CH')
    SELECT vot_id, ini_nr, legislatura, ini_titulo, fase, data, resultado, (SELECT count(*) FROM hit) AS total
    FROM hit ORDER BY data DESC NULLS LAST, vot_id DESC LIMIT 50""")
def _(w):
    return votes.list_votes(w.table("votacoes"), partido_contra="ch").page_with_total()


@entry("q5_vote_record", f"{flat.VOTE_SQL} WHERE vot.vot_id = (SELECT max(vot_id) FROM vot)")
def _(w):
    """The whole record of the largest id, whichever that is in the data."""
    table = w.table("votacoes")
    last = table.agg(F.max("vot_id"))
    return table.where(F.col("vot_id") == last.scalar()).limit(1).select(*flat.vote_columns())


# --- legislatures -------------------------------------------------------------------------------


@entry("q6_legislatures", """
    SELECT b.legislatura, sigla, dtini, dtfim, num_deputados, num_grupos FROM base b
    JOIN (SELECT legislatura, count(*) AS num_deputados FROM dep GROUP BY 1) d ON d.legislatura = b.legislatura
    JOIN (SELECT legislatura, count(*) AS num_grupos FROM part GROUP BY 1) g ON g.legislatura = b.legislatura""")
def _(w):
    return legislatures.list_legislatures(w.table("info_base"), w.table("iniciativas")).page


@entry("q6_legislatures_fallback", """
    SELECT legislatura, legislatura AS sigla, min(data_inicio_leg) AS dtini, CAST(NULL AS DATE) AS dtfim,
      CAST(NULL AS BIGINT) AS num_deputados, CAST(NULL AS BIGINT) AS num_grupos FROM ini GROUP BY legislatura""")
def _(w):
    from hemiciclo.sources.readers import read_dataset

    nothing = read_dataset(w.spark, w.scratch(), "info_base", optional=True)
    return legislatures.list_legislatures(nothing, w.table("iniciativas")).page


@entry("q7_legislature_record", """
    SELECT 'deputado' AS kind, legislatura, nome_completo AS name FROM dep WHERE legislatura = 'L17'
    UNION ALL SELECT 'grupo', legislatura, gp_nome FROM part WHERE legislatura = 'L17'
    UNION ALL SELECT 'circulo', legislatura, cp_des FROM circ WHERE legislatura = 'L17'
    UNION ALL SELECT 'estado', legislatura, 'described' FROM (SELECT DISTINCT legislatura FROM ini)
    UNION ALL SELECT 'registos', 'L17', '1'""")
def _(w):
    base = w.table("info_base")
    docs = legislatures.legislature(base, "l17")
    parts = [("deputado", "Deputados.DepNomeCompleto"), ("grupo", "GruposParlamentares.nome"), ("circulo", "CirculosEleitorais.cpDes")]
    status = legislatures.legislature_status(base, w.table("iniciativas"))
    out = status.select(F.lit("estado").alias("kind"), LEG, F.col("status").alias("name"))
    out = out.unionByName(docs.groupBy(LEG).agg(F.lit("registos").alias("kind"), F.count(F.lit(1)).cast("string").alias("name")))
    for kind, field in parts:
        out = out.unionByName(docs.select(F.lit(kind).alias("kind"), LEG, F.explode(field).alias("name")))
    return out


# --- people and places --------------------------------------------------------------------------

_DEPUTY = "legislatura, dep_cad_id, nome_parlamentar, circulo_atual, partido_atual, situacao_atual"


@entry("q8_deputies", f"""
    WITH hit AS (SELECT * FROM dep WHERE situacao_atual = 'Efetivo' AND nome_parlamentar ILIKE '%customer#%5%')
    SELECT {_DEPUTY}, (SELECT count(*) FROM hit) AS total FROM hit
    ORDER BY nome_parlamentar, legislatura, dep_cad_id LIMIT 50""")
def _(w):
    return people.list_deputies(w.table("deputados"), situacao="Efetivo", q="customer#%5").page_with_total()


@entry("q8_deputies_of_party_and_circle", f"""
    WITH hit AS (SELECT * FROM dep WHERE legislatura = 'L15' AND partido_atual = 'PAN' AND circulo_atual = 'NATION_7')
    SELECT {_DEPUTY}, (SELECT count(*) FROM hit) AS total FROM hit
    ORDER BY nome_parlamentar, legislatura, dep_cad_id LIMIT 50""")
def _(w):
    return people.list_deputies(w.table("deputados"), legislatura="L15", partido="pan", circulo="NATION_7").page_with_total()


@entry("q9_deputy_record", """
    SELECT legislatura, dep_cad_id, nome_parlamentar, nome_completo, circulo_atual, circulo_id, partido_atual,
      situacao_atual FROM dep WHERE dep_cad_id = 77 AND legislatura = 'L15'""")
def _(w):
    return people.deputy(w.table("deputados"), 77, "L15").select(
        LEG, "dep_cad_id", "nome_parlamentar", "nome_completo", "circulo_atual", "circulo_id", "partido_atual",
        "situacao_atual",
    )


_INI = "ini_id, ini_nr, legislatura, ini_tipo, ini_desc_tipo, ini_titulo"


@entry("q10_deputy_initiatives", f"""
    WITH hit AS (SELECT * FROM ini WHERE o_orderkey IN (SELECT o_orderkey FROM signer WHERE dep_id = '77')
      AND legislatura = 'L15')
    SELECT {_INI}, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY ini_nr DESC, ini_id LIMIT 50""")
def _(w):
    return people.deputy_initiatives(w.table("deputados"), w.table("iniciativas"), "77.0", "L15").page_with_total()


@entry("q11_circles", """
    SELECT legislatura, cp_id, cp_des, (SELECT count(*) FROM circ) AS total FROM circ
    ORDER BY cp_des, legislatura, cp_id LIMIT 50 OFFSET 25""")
def _(w):
    return people.list_circles(w.table("circulos"), offset=25).page_with_total()


@entry("q12_circle_record", "SELECT legislatura, cp_id, cp_des FROM circ WHERE cp_id = 11 AND legislatura = 'L14'")
def _(w):
    return people.circle(w.table("circulos"), 11, "L14").select(LEG, "cp_id", "cp_des")


@entry("q13_circle_deputies", f"""
    WITH hit AS (SELECT * FROM dep WHERE circulo_id = 11 AND legislatura = 'L14' AND situacao_atual = 'Efetivo')
    SELECT {_DEPUTY}, (SELECT count(*) FROM hit) AS total FROM hit
    ORDER BY nome_parlamentar, legislatura, dep_cad_id LIMIT 50""")
def _(w):
    return people.circle_deputies(w.table("circulos"), w.table("deputados"), 11, "L14").page_with_total()


@entry("q14_parties", """
    SELECT legislatura, gp_sigla, gp_nome, (SELECT count(*) FROM part) AS total FROM part
    ORDER BY gp_sigla, legislatura LIMIT 50""")
def _(w):
    return people.list_parties(w.table("partidos")).page_with_total()


@entry("q15_party_record", "SELECT legislatura, gp_sigla, gp_nome FROM part WHERE gp_sigla = 'CDS-PP' AND legislatura = 'L16'")
def _(w):
    return people.party(w.table("partidos"), "cds-pp", "l16").select(LEG, "gp_sigla", "gp_nome")


@entry("q16_party_deputies", f"""
    WITH hit AS (SELECT * FROM dep WHERE partido_atual = 'PS' AND legislatura = 'L13')
    SELECT {_DEPUTY}, (SELECT count(*) FROM hit) AS total FROM hit
    ORDER BY nome_parlamentar, legislatura, dep_cad_id LIMIT 50""")
def _(w):
    return people.party_deputies(w.table("partidos"), w.table("deputados"), "ps", "L13").page_with_total()


@entry("q17_party_initiatives", f"""
    WITH hit AS (SELECT * FROM ini WHERE legislatura = 'L17'
      AND o_orderkey IN (SELECT o_orderkey FROM author WHERE gp = 'JPP'))
    SELECT {_INI}, (SELECT count(*) FROM hit) AS total FROM hit
    ORDER BY ini_data DESC NULLS LAST, ini_id DESC LIMIT 50""")
def _(w):
    return people.party_initiatives(w.table("partidos"), w.table("iniciativas"), "jpp", "L17").page_with_total()


_SUPPORT = """
    SELECT pos.legislatura, a.gp AS author, fase, party, count(*) FILTER (position = 'a_favor') AS a_favor_count,
      count(*) FILTER (position = 'contra') AS contra_count, count(*) FILTER (position = 'abstencao') AS abstencao_count
    FROM pos JOIN (SELECT DISTINCT o_orderkey, gp FROM author) a ON a.o_orderkey = pos.o_orderkey
    WHERE fase IS NOT NULL AND position <> 'ausencia'"""


@entry("q18_vote_support", f"{_SUPPORT} GROUP BY pos.legislatura, a.gp, fase, party")
def _(w):
    support = statistics.vote_support(w.table("votacoes"))
    return statistics.ranked(support, None, "author", "fase", "party")


@entry("q18_vote_support_of_party", f"""
    {_SUPPORT} AND a.gp = 'JPP' AND pos.legislatura = 'L17' GROUP BY pos.legislatura, a.gp, fase, party""")
def _(w):
    nested = statistics.party_vote_support(w.table("partidos"), w.table("votacoes"), "jpp", "l17")
    return nested.select(LEG, "author", "fase", F.inline("vote_details")).withColumnsRenamed(
        {p: f"{p}_count" for p in statistics.VOTED}
    )


# --- activities ---------------------------------------------------------------------------------


@entry("q19_activities", """
    WITH hit AS (SELECT act.*, autores_gp FROM act JOIN act_authors ON act_authors.event_id = act.event_id
      WHERE tipo = 'VOT' AND assunto ILIKE '%vie_ 1%' AND data_entrada BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
        AND act.event_id IN (SELECT event_id FROM act_author WHERE gp = 'PSD'))
    SELECT ativ_id, legislatura, tipo AS ativ_tipo, desc_tipo AS ativ_desc_tipo, numero AS ativ_numero,
      assunto AS ativ_assunto, data_entrada, autores_gp AS ativ_autores_gp, has_votes, (SELECT count(*) FROM hit) AS total
    FROM hit ORDER BY data_entrada DESC NULLS LAST, ativ_id LIMIT 50""")
def _(w):
    return listed(activities.list_activities(
        w.table("atividades"), tipo="VOT", autor_gp="psd", data_desde=date(2024, 1, 5), data_ate=date(2024, 1, 25),
        q=" vie_ 1 ",
    ), "ativ_autores_gp")


@entry("q19_activities_unfiltered", """
    SELECT ativ_id, legislatura, tipo AS ativ_tipo, desc_tipo AS ativ_desc_tipo, numero AS ativ_numero,
      assunto AS ativ_assunto, data_entrada, autores_gp AS ativ_autores_gp, has_votes, (SELECT count(*) FROM act) AS total
    FROM act LEFT JOIN act_authors ON act_authors.event_id = act.event_id
    ORDER BY data_entrada DESC NULLS LAST, ativ_id LIMIT 500""")
def _(w):
    return listed(activities.list_activities(w.table("atividades"), limit=500), "ativ_autores_gp")


@entry("q20_activity_record", f"{flat.ACTIVITY_SQL} WHERE act.ativ_id = (SELECT min(ativ_id) FROM act)")
def _(w):
    """The whole record of the smallest key, all votes of its list included."""
    table = w.table("atividades")
    first = table.agg(F.min("ativ_id")).scalar()
    return table.where(F.col("ativ_id") == first).limit(1).select("ativ_id", LEG, *flat.activity_columns())


_AVOT = "vot_id, ativ_id, legislatura, assunto, tipo, data, resultado, has_party_details"


@entry("q21_activity_votes", f"""
    WITH hit AS (SELECT * FROM avot WHERE resultado = 'Rejeitado' AND has_party_details AND assunto ILIKE '%e%'
      AND data BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
      AND vot_id IN (SELECT vot_id FROM apos WHERE position = 'a_favor' AND party = 'IL')
      AND vot_id IN (SELECT vot_id FROM apos WHERE position = 'contra' AND party = 'PSD')
      AND vot_id IN (SELECT vot_id FROM apos WHERE position = 'abstencao' AND party = 'PCP'))
    SELECT {_AVOT}, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY data DESC NULLS LAST, vot_id LIMIT 50""")
def _(w):
    return activities.list_activity_votes(
        w.table("atividades_votacoes"), resultado="Rejeitado", has_party_details=True, q="E",
        data_desde=date(2024, 1, 5), data_ate=date(2024, 1, 25), partido_favor="IL", partido_contra="PSD",
        partido_abstencao="PCP",
    ).page_with_total()


@entry("q21_activity_votes_by_type", f"""
    WITH hit AS (SELECT * FROM avot WHERE legislatura = 'L13' AND tipo = 'MOC')
    SELECT {_AVOT}, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY data DESC NULLS LAST, vot_id LIMIT 500""")
def _(w):
    return activities.list_activity_votes(
        w.table("atividades_votacoes"), legislatura="L13", tipo="MOC", limit=500
    ).page_with_total()


@entry("q22_activity_vote_record", f"{flat.ACTIVITY_VOTE_SQL} WHERE avot.vot_id = (SELECT max(vot_id) FROM avot)")
def _(w):
    table = w.table("atividades_votacoes")
    last = table.agg(F.max("vot_id")).scalar()
    return table.where(F.col("vot_id") == last).limit(1).select(*flat.activity_vote_columns())


# --- topics -------------------------------------------------------------------------------------


@entry("q23_topics", """
    WITH hit AS (SELECT topic.*, ini_nr, ini_tipo, ini_desc_tipo, ini_titulo, ini_data FROM topic
      JOIN ini ON ini.ini_id = topic.ini_id WHERE cap = 3 AND ini_tipo = 'J' AND ini_titulo ILIKE '%ciativa%'
        AND ini.o_orderkey IN (SELECT o_orderkey FROM author WHERE gp = 'BE'))
    SELECT ini_id, legislatura, cap, cap_label, model_version, ini_nr, ini_tipo, ini_desc_tipo, ini_titulo,
      (SELECT count(*) FROM hit) AS total
    FROM hit ORDER BY legislatura DESC, ini_data DESC NULLS LAST, ini_id DESC LIMIT 50""")
def _(w):
    return topics.list_topics(
        w.table("cap"), w.table("iniciativas"), cap=3, tipo="J", autor_gp="be", q="CIATIVA"
    ).page_with_total()


@entry("q23_topics_unfiltered", """
    SELECT topic.ini_id, topic.legislatura, cap, cap_label, model_version, ini_nr, ini_tipo, ini_desc_tipo, ini_titulo,
      (SELECT count(*) FROM topic) AS total
    FROM topic JOIN ini ON ini.ini_id = topic.ini_id
    ORDER BY topic.legislatura DESC, ini_data DESC NULLS LAST, topic.ini_id DESC LIMIT 500""")
def _(w):
    return topics.list_topics(w.table("cap"), w.table("iniciativas"), limit=500).page_with_total()


@entry("q24_topic_record", """
    SELECT topic.ini_id, topic.legislatura, cap, cap_label, model_version, ini_nr, ini_tipo, ini_desc_tipo, ini_titulo
    FROM topic JOIN ini ON ini.ini_id = topic.ini_id WHERE topic.ini_id = '77'""")
def _(w):
    return topics.topic(w.table("cap"), w.table("iniciativas"), "77")


# --- statistics ---------------------------------------------------------------------------------

_Q25 = """
    SELECT legislatura, fase, resultado, count(*) AS vote_count, count(DISTINCT ini_id) AS initiative_count FROM vot
    WHERE fase IS NOT NULL AND resultado IS NOT NULL GROUP BY legislatura, fase, resultado"""
_Q26_TOTALS = """
    SELECT legislatura, gp AS party, count(DISTINCT ini_id) AS total_initiatives
    FROM author JOIN ini ON author.o_orderkey = ini.o_orderkey GROUP BY legislatura, gp"""
_Q26 = f"""
    SELECT t.legislatura, t.party, total_initiatives, fase, resultado, vote_count FROM ({_Q26_TOTALS}) t LEFT JOIN (
      SELECT legislatura, gp AS party, fase, resultado, count(*) AS vote_count
      FROM author JOIN vot ON author.o_orderkey = vot.o_orderkey
      WHERE fase IS NOT NULL AND resultado IS NOT NULL GROUP BY legislatura, gp, fase, resultado
    ) o ON o.legislatura = t.legislatura AND o.party = t.party"""
_Q27 = "SELECT legislatura, fase, count(*) AS vote_count FROM vot WHERE fase IS NOT NULL GROUP BY legislatura, fase"
_Q28 = """
    SELECT legislatura, party, CASE position WHEN 'a_favor' THEN 'A Favor' WHEN 'contra' THEN 'Contra'
      ELSE 'Abstenção' END AS vote_type, count(*) AS vote_count
    FROM pos WHERE position <> 'ausencia' GROUP BY legislatura, party, position"""
_Q29 = 'SELECT legislatura, tipo, count(*) AS "count" FROM ativ WHERE tipo IS NOT NULL GROUP BY legislatura, tipo'
_Q30 = "SELECT legislatura, tipo, count(*) AS vote_count FROM avot WHERE tipo IS NOT NULL GROUP BY legislatura, tipo"
_Q31 = """
    SELECT v.legislatura, iniciativas, atividades, iniciativas + atividades AS total
    FROM (SELECT legislatura, count(*) AS iniciativas FROM vot GROUP BY legislatura) v
    JOIN (SELECT legislatura, count(*) AS atividades FROM avot GROUP BY legislatura) a ON a.legislatura = v.legislatura"""


@entry("q25_initiatives_by_phase", _Q25)
def _(w):
    return statistics.ranked(statistics.initiatives_by_phase(w.table("votacoes")), None, "fase", "resultado")


@entry("q26_initiatives_by_party", _Q26)
def _(w):
    report = statistics.ranked(
        statistics.initiatives_by_party(w.table("iniciativas"), w.table("votacoes")), "total_initiatives", "party"
    )
    return report.select(LEG, "party", "total_initiatives", F.inline_outer("fase_outcomes")).withColumnRenamed(
        "count", "vote_count"
    )


@entry("q27_votes_by_phase", _Q27)
def _(w):
    return statistics.ranked(statistics.votes_by_phase(w.table("votacoes")), "vote_count", "fase")


@entry("q28_votes_by_party_position", _Q28)
def _(w):
    return statistics.ranked(statistics.votes_by_party_and_position(w.table("votacoes")), None, "party", "vote_type")


@entry("q29_activities_by_type", _Q29)
def _(w):
    return statistics.ranked(statistics.activities_by_type(w.table("atividades")), "count", "tipo")


@entry("q30_activity_votes_by_type", _Q30)
def _(w):
    return statistics.ranked(statistics.activity_votes_by_type(w.table("atividades_votacoes")), "vote_count", "tipo")


@entry("q31_vote_sources", _Q31)
def _(w):
    return statistics.ranked(statistics.vote_sources(w.table("votacoes"), w.table("atividades_votacoes")), None)


@entry("q32_statistics_bundle", f"""
    SELECT legislatura, 'fase' AS section, fase || '/' || resultado AS item, vote_count AS a, initiative_count AS b FROM ({_Q25})
    UNION ALL SELECT legislatura, 'partido', party, total_initiatives, CAST(NULL AS BIGINT) FROM ({_Q26_TOTALS})
    UNION ALL SELECT legislatura, 'evento', fase, vote_count, NULL FROM ({_Q27})
    UNION ALL SELECT legislatura, 'voto', party || '/' || vote_type, vote_count, NULL FROM ({_Q28})
    UNION ALL SELECT legislatura, 'atividade', tipo, "count", NULL FROM ({_Q29})
    UNION ALL SELECT legislatura, 'voto de atividade', tipo, vote_count, NULL FROM ({_Q30})
    UNION ALL SELECT legislatura, 'fonte', 'total', total, iniciativas FROM ({_Q31})""")
def _(w):
    """The nested record of every legislature, laid out a line an item."""
    report = statistics.bundle(
        w.table("iniciativas"), w.table("votacoes"), w.table("atividades"), w.table("atividades_votacoes")
    )

    def items(section, field, item, a, b=None):
        return F.transform(field, lambda x: F.struct(
            F.lit(section).alias("section"), item(x).alias("item"), big(x[a]).alias("a"),
            (big(x[b]) if b else F.lit(None).cast("bigint")).alias("b"),
        ))

    both = lambda x, left, right: F.concat_ws("/", x[left], x[right])
    sections = [
        items("fase", "initiatives_by_fase", lambda x: both(x, "fase", "resultado"), "vote_count", "initiative_count"),
        items("partido", "initiatives_by_party", lambda x: x["party"], "total_initiatives"),
        items("evento", "votes_by_event_type", lambda x: x["fase"], "vote_count"),
        items("voto", "votes_by_party_and_type", lambda x: both(x, "party", "vote_type"), "vote_count"),
        items("atividade", "atividades_by_tipo", lambda x: x["tipo"], "count"),
        items("voto de atividade", "atividades_votes_by_tipo", lambda x: x["tipo"], "vote_count"),
        items("fonte", F.array("vote_source_breakdown"), lambda x: F.lit("total"), "total", "iniciativas"),
    ]
    return report.select(LEG, F.inline(F.concat(*sections)))


@entry("q33_inventory", """
    SELECT 'iniciativas' AS dataset, count(*) AS n_rows, true AS required, true AS available, 'healthy' AS status FROM ini
    UNION ALL SELECT 'votacoes', count(*), true, true, 'healthy' FROM vot
    UNION ALL SELECT 'deputados', count(*), false, true, 'healthy' FROM dep
    UNION ALL SELECT 'partidos', count(*), false, true, 'healthy' FROM part
    UNION ALL SELECT 'circulos', count(*), false, true, 'healthy' FROM circ
    UNION ALL SELECT 'info_base', count(*), false, true, 'healthy' FROM base""")
def _(w):
    w.build(*inventory.CHECKED)
    return inventory.inventory(w.spark, w.silver)


@entry("q34_coverage", "SELECT DISTINCT legislatura FROM ini")
def _(w):
    return inventory.coverage(w.table("iniciativas"))
