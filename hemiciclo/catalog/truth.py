"""The expected tables as flat SQL over the given tables: no nesting, unnesting or parsing."""

from __future__ import annotations

import re

from hemiciclo.fixtures import PARTIES, PHASES
from hemiciclo.schemas import TOPIC_LABELS


def _values(rows, names: str) -> str:
    listed = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) v({names})"


def _leg(n: str) -> str:
    return f"'L' || CAST(13 + {n} % 5 AS VARCHAR)"


_PHASE = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHASES, 1))

VIEWS: dict[str, str] = {
    "gps": _values(list(enumerate(PARTIES)), "i, gp"),
    "legs": _values([(k,) for k in range(13, 18)], "k"),
    "book": _values([(i, c, t) for i, (c, t) in enumerate(TOPIC_LABELS.items())], "i, code, label"),
    "evt": f"""
        SELECT *, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS evt_id,
          CASE l_linenumber {_PHASE} END AS fase,
          CASE WHEN l_suppkey % 11 <> 0 THEN CAST(l_shipdate AS DATE) END AS data_fase,
          CASE l_suppkey % 10 WHEN 0 THEN 'oev-' || evt_id END AS oev_id,
          CASE l_suppkey % 10 WHEN 2 THEN CAST(l_linenumber + 100 AS VARCHAR) END AS codigo_fase,
          CASE l_suppkey % 10 WHEN 3 THEN 'Obs ' || evt_id END AS obs_fase,
          CASE l_suppkey % 10 WHEN 4 THEN 'Comissão ' || l_suppkey % 12 END AS comissao,
          CASE l_suppkey % 20 WHEN 5 THEN 'af-' || evt_id || '|anexo' END AS anexos_fase,
          CASE l_suppkey % 10 WHEN 6 THEN 'https://example.org/fase/' || l_linenumber END AS links_fase,
          CASE l_suppkey % 10 WHEN 7 THEN CAST(l_partkey AS VARCHAR) END AS act_id,
          CASE l_suppkey % 20 WHEN 8 THEN 'aj-' || l_linenumber END AS atividades_conjuntas,
          CASE l_suppkey % 20 WHEN 9 THEN l_partkey || '|' || l_partkey || 'b' END AS iniciativas_conjuntas
        FROM lineitem""",
    "ini": f"""
        SELECT o_orderkey, o_custkey, CAST(o_orderkey AS VARCHAR) AS ini_id,
          CAST(o_orderkey % 400 AS VARCHAR) AS ini_nr, {_leg('o_orderkey')} AS legislatura,
          CASE o_orderstatus WHEN 'F' THEN 'J' WHEN 'O' THEN 'R' ELSE 'P' END AS ini_tipo,
          CASE o_orderstatus WHEN 'F' THEN 'Projeto de Lei' WHEN 'O' THEN 'Projeto de Resolução'
            ELSE 'Proposta de Lei' END AS ini_desc_tipo,
          'Iniciativa ' || o_orderpriority || ' nº ' || o_orderkey AS ini_titulo,
          DATE '1995-01-01' + CAST(365 * (o_orderkey % 5) AS INTEGER) AS data_inicio_leg,
          CASE o_custkey % 10 WHEN 0 THEN 'Governo' WHEN 1 THEN 'Comissões'
            ELSE 'Grupos Parlamentares' END AS autor_tipo,
          CASE o_custkey % 10 WHEN 0 THEN 'G' WHEN 1 THEN 'C' END AS autor_sigla,
          CASE WHEN o_orderkey % 5 < 4 THEN DATE '1995-01-01' + CAST(365 * (o_orderkey % 5) + 364 AS INTEGER) END AS data_fim_leg,
          CASE o_orderkey % 10 WHEN 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'XIII' END END AS ini_leg,
          CASE o_orderkey % 10 WHEN 1 THEN CAST(o_orderkey % 4 + 1 AS VARCHAR) END AS ini_sel,
          CASE o_orderkey % 10 WHEN 2 THEN 'SIM' END AS ini_texto_subst,
          CASE o_orderkey % 10 WHEN 3 THEN 'https://example.org/texto/' || o_orderkey END AS ini_link_texto,
          CASE o_orderkey % 11 WHEN 0 THEN 'Epígrafe ' || o_orderkey END AS ini_epigrafe,
          CASE o_orderkey % 11 WHEN 1 THEN 'Obs ' || o_orderkey END AS ini_obs,
          CASE o_orderkey % 11 WHEN 2 THEN 'Campo ' || o_orderkey END AS ini_texto_subst_campo,
          CASE o_orderkey % 17 WHEN 0 THEN 'COM(' || o_orderkey || ')' END AS iniciativas_europeias,
          CASE o_orderkey % 17 WHEN 1 THEN '[{{"url":"https://example.org/' || o_orderkey || '"}}]' END AS links,
          CASE o_orderkey % 17 WHEN 2 THEN 'PA ' || o_orderkey END AS propostas_alteracao,
          CASE o_orderkey % 13 WHEN 0 THEN 'anexo-' || o_orderkey || '|anexo' END AS ini_anexos,
          CASE o_orderkey % 13 WHEN 1 THEN CAST(o_orderkey - 1 AS VARCHAR) END AS iniciativas_origem,
          CASE o_orderkey % 13 WHEN 2 THEN (o_orderkey + 1) || '|' || (o_orderkey + 2) END AS iniciativas_originadas,
          CASE o_orderkey % 13 WHEN 3 THEN 'P-' || o_orderkey END AS peticoes,
          first_day AS ini_data, COALESCE(n_events, 0) AS n_events
        FROM orders LEFT JOIN (
          SELECT l_orderkey, min(data_fase) AS first_day, count(*) AS n_events FROM evt GROUP BY l_orderkey
        ) e ON l_orderkey = o_orderkey""",
    "signer": """
        SELECT o_orderkey, 1 AS k, CAST(o_custkey AS VARCHAR) AS dep_id,
          CASE WHEN o_custkey % 4 = 0 THEN 'Deputado ' || o_custkey END AS nome FROM orders WHERE o_custkey % 3 <> 0
        UNION ALL
        SELECT o_orderkey, 2, CAST(o_custkey + 1 AS VARCHAR), CASE WHEN o_custkey % 4 = 3 THEN 'Deputado ' || (o_custkey + 1) END
        FROM orders WHERE o_custkey % 9 = 4""",
    "signers": """
        SELECT o_orderkey, string_agg(concat_ws(':', dep_id, nome), '|' ORDER BY k) AS autores_deputados FROM signer GROUP BY o_orderkey""",
    "author": """
        SELECT o_orderkey, i, gp FROM orders JOIN gps ON (o_custkey + i) % 4 = 0 WHERE o_custkey % 10 NOT IN (0, 1)
        UNION ALL
        SELECT o_orderkey, 10, gp FROM orders JOIN gps ON i = (4 - o_custkey % 4) % 4 WHERE o_custkey % 50 = 7""",
    "authors": "SELECT o_orderkey, string_agg(gp, '|' ORDER BY gp) AS autor_gp FROM author GROUP BY o_orderkey",
    "vot": """
        SELECT evt_id || '-v' AS vot_id, ini_id, ini_nr, legislatura, ini_titulo, ini_tipo, fase, data_fase,
          CASE WHEN l_suppkey % 13 <> 0 THEN CAST(l_shipdate AS DATE) + 1 END AS data,
          CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Aprovado'
            ELSE 'Rejeitado' END AS resultado,
          CAST(l_linenumber AS VARCHAR) AS reuniao, 'RP' AS tipo_reuniao,
          CASE WHEN l_suppkey % 7 = 0 THEN 'unanime' END AS unanime,
          CASE l_suppkey % 10 WHEN 1 THEN 'Requerimento ' || l_linenumber END AS descricao, l_suppkey,
          l_suppkey % 7 <> 0 AND l_quantity >= 48 AS is_nominal, l_suppkey % 7 <> 0 AS parsed,
          l_orderkey AS o_orderkey, l_partkey, l_linenumber, l_quantity
        FROM evt JOIN ini ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'""",
    "named": """
        SELECT r, string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((r + i) % 7 = 0) AS absent,
          string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((r + i) % 7 <> 0 AND (r + i) % 3 = 0) AS favour,
          string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((r + i) % 7 <> 0 AND (r + i) % 3 = 1) AS against,
          string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((r + i) % 7 <> 0 AND (r + i) % 3 = 2) AS abstained
        FROM gps CROSS JOIN range(21) t(r) GROUP BY r""",
    "members": """
        SELECT string_agg('Deputado Exemplo ' || k || ' (PSD)', ', ' ORDER BY k) AS many FROM range(1, 61) t(k)""",
    "vot_text": """
        SELECT vot_id, g.gp || '|ZZ' AS ausencias, CASE WHEN parsed THEN concat_ws('<BR>',
            CASE WHEN l_quantity = 25 THEN 'Contra: <I>ZZ</I>' END,
            'A Favor: ' || concat_ws(', ', favour, CASE WHEN l_linenumber = 6 AND l_partkey % 2 = 0 THEN 'Membro Exemplo (Ninsc)' END,
              CASE WHEN l_quantity >= 40 THEN '6-PSD, Maria Exemplo (PS), 12' END, CASE WHEN l_quantity >= 48 THEN many END),
            'Contra: ' || COALESCE(against, ''), 'Abstenção: ' || COALESCE(abstained, ''),
            CASE WHEN l_quantity < 10 THEN 'Ausência: ' || COALESCE(absent, '') WHEN l_quantity < 20 THEN 'Ausencia: ' || COALESCE(absent, '') END)
          WHEN l_partkey % 3 = 0 THEN '   ' END AS detalhe
        FROM vot JOIN named ON r = l_partkey % 21 CROSS JOIN members
        LEFT JOIN gps g ON l_suppkey % 12 = 2 AND g.i = l_partkey % 10""",
    "pos": """
        SELECT v.*, gp AS party, CASE WHEN (l_partkey + i) % 7 = 0 THEN 'ausencia'
            WHEN (l_partkey + i) % 3 = 0 THEN 'a_favor' WHEN (l_partkey + i) % 3 = 1 THEN 'contra'
            ELSE 'abstencao' END AS position
        FROM vot v CROSS JOIN gps
        WHERE parsed AND ((l_partkey + i) % 7 <> 0 OR (l_quantity >= 10 AND l_quantity < 20))
        UNION ALL
        SELECT v.*, 'Membro Exemplo (Ninsc)', 'a_favor' FROM vot v
        WHERE parsed AND l_linenumber = 6 AND l_partkey % 2 = 0""",
    "vot_lists": """
        SELECT vot_id, string_agg(party, '|' ORDER BY party) FILTER (position = 'a_favor') AS a_favor,
          string_agg(party, '|' ORDER BY party) FILTER (position = 'contra') AS contra,
          string_agg(party, '|' ORDER BY party) FILTER (position = 'abstencao') AS abstencao,
          string_agg(party, '|' ORDER BY party) FILTER (position = 'ausencia') AS ausencia FROM pos GROUP BY vot_id""",
    "ativ": f"""
        SELECT event_id, {_leg('user_id')} AS legislatura, user_id,
          CASE event_type WHEN 'view' THEN 'VOT' WHEN 'click' THEN 'MOC' WHEN 'purchase' THEN 'PRG'
            WHEN 'signup' THEN 'OEX' WHEN 'error' THEN 'SES' END AS tipo,
          CASE event_type WHEN 'view' THEN 'Voto' WHEN 'click' THEN 'Moção' WHEN 'purchase' THEN 'Programa'
            WHEN 'signup' THEN 'Eleição' WHEN 'error' THEN 'Sessão' END AS desc_tipo,
          CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS VARCHAR) END AS numero,
          CASE WHEN event_id % 20 <> 11 THEN event_type || ' ' || event_id END AS assunto,
          CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END AS data_entrada,
          value > 10 AS has_votes, CAST(ts AS DATE) AS day,
          CASE event_id % 10 WHEN 0 THEN CAST(event_id % 4 + 1 AS VARCHAR) END AS sessao,
          CASE event_id % 10 WHEN 1 THEN CAST(ts AS DATE) + 7 END AS data_agendamento_debate,
          CASE event_id % 10 WHEN 2 THEN CAST(ts AS DATE) + 1 END AS data_anuncio,
          CASE user_id % 10 WHEN 3 THEN 'Grupo Parlamentar' END AS tipo_autor,
          CASE event_id % 10 WHEN 4 THEN 'DAR ' || event_id END AS publicacao,
          CASE event_id % 10 WHEN 5 THEN 'DAR-D ' || event_id || '|II' END AS publicacao_debate,
          CASE event_id % 10 WHEN 6 THEN 'Nota ' || event_id END AS observacoes
        FROM events""",
    "act": """
        SELECT *, CASE WHEN numero IS NOT NULL THEN legislatura || '_' || tipo || '_' || numero ELSE
          legislatura || '_' || md5(COALESCE(assunto, '') || COALESCE(CAST(data_entrada AS VARCHAR), ''))
          END AS ativ_id FROM ativ""",
    "act_author": """
        SELECT event_id, gp FROM events JOIN gps ON (user_id + i) % 5 = 0 WHERE user_id % 6 <> 0""",
    "act_authors": """
        SELECT event_id, string_agg(gp, '|' ORDER BY gp) AS autores_gp FROM act_author GROUP BY event_id""",
    "avot": """
        SELECT 'av-' || event_id AS vot_id, ativ_id, legislatura, assunto, tipo, numero, data_entrada,
          CASE WHEN event_id % 13 <> 0 THEN day + 1 END AS data,
          CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'Rejeitado'
            ELSE 'Aprovado' END AS resultado,
          event_id % 8 = 0 AS has_party_details, event_id,
          CASE event_id % 20 WHEN 2 THEN 'Requerimento ' || event_id % 7 END AS descricao,
          CASE event_id % 20 WHEN 3 THEN CAST(event_id % 30 AS VARCHAR) END AS reuniao,
          CASE event_id % 20 WHEN 4 THEN 'unanime' END AS unanime, CASE event_id % 20 WHEN 5 THEN 'PS|L' END AS ausencias
        FROM act WHERE has_votes""",
    "avot_text": """
        SELECT vot_id, 'A Favor: ' || string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((event_id + i) % 3 = 0)
            || '<BR>Contra: ' || string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((event_id + i) % 3 = 1)
            || '<BR>Abstenção: ' || string_agg('<I>' || gp || '</I>', ', ' ORDER BY i) FILTER ((event_id + i) % 3 = 2) AS detalhe,
          string_agg(gp, '|' ORDER BY gp) FILTER ((event_id + i) % 3 = 0) AS a_favor,
          string_agg(gp, '|' ORDER BY gp) FILTER ((event_id + i) % 3 = 1) AS contra,
          string_agg(gp, '|' ORDER BY gp) FILTER ((event_id + i) % 3 = 2) AS abstencao
        FROM avot CROSS JOIN gps WHERE has_party_details GROUP BY vot_id""",
    "apos": """
        SELECT v.*, gp AS party, CASE (event_id + i) % 3 WHEN 0 THEN 'a_favor' WHEN 1 THEN 'contra'
          ELSE 'abstencao' END AS position
        FROM avot v CROSS JOIN gps WHERE has_party_details""",
    "dep": f"""
        SELECT c_custkey, {_leg('c_custkey')} AS legislatura, CAST(c_custkey AS DOUBLE) AS dep_cad_id,
          c_name AS nome_parlamentar, 'Nome ' || c_name AS nome_completo, n_name AS circulo_atual,
          CAST(c_nationkey AS DOUBLE) AS circulo_id, gp AS partido_atual,
          CASE c_custkey % 3 WHEN 0 THEN 'Efetivo' WHEN 1 THEN 'Renunciou' ELSE 'Suplente' END AS situacao_atual
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN gps ON c_custkey % 50 <> 49
          AND i = CASE WHEN c_custkey % 4 = 0 THEN (c_custkey + 3) % 10 ELSE c_custkey % 10 END""",
    "dep_gp": """
        SELECT c_custkey, 1 AS n, i, gp FROM customer JOIN gps ON i = c_custkey % 10 WHERE c_custkey % 50 <> 49
        UNION ALL
        SELECT c_custkey, 2, i, gp FROM customer JOIN gps ON i = (c_custkey + 3) % 10
        WHERE c_custkey % 50 <> 49 AND c_custkey % 4 = 0""",
    "circ": """
        SELECT 'L' || k AS legislatura, CAST(n_nationkey AS DOUBLE) AS cp_id, n_name AS cp_des
        FROM nation CROSS JOIN legs""",
    "part": """
        SELECT DISTINCT legislatura, dep_gp.gp AS gp_sigla, 'Partido ' || dep_gp.gp AS gp_nome
        FROM dep_gp JOIN dep ON dep.c_custkey = dep_gp.c_custkey""",
    "base": """
        SELECT 'L' || k AS legislatura,
          CASE k WHEN 13 THEN 'XIII' WHEN 14 THEN 'XIV' WHEN 15 THEN 'XV' WHEN 16 THEN 'XVI' ELSE 'XVII' END AS sigla,
          DATE '1995-01-01' + CAST(365 * (k - 13) AS INTEGER) AS dtini,
          CASE WHEN k < 17 THEN DATE '1995-01-01' + CAST(365 * (k - 13) + 364 AS INTEGER) END AS dtfim
        FROM legs""",
    "topic": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS ini_id, {_leg('o_orderkey')} AS legislatura,
          CASE WHEN o_orderkey % 300 = 0 THEN 11 ELSE code END AS cap,
          CASE WHEN o_orderkey % 300 <> 0 THEN label END AS cap_label,
          'synthetic-v1' AS model_version, o_orderkey
        FROM orders JOIN book ON i = o_orderkey % {len(TOPIC_LABELS)} WHERE o_orderstatus <> 'P'""",
}


def with_truth(sql: str) -> str:
    """Put the definitions of the views that ``sql`` names in front of it."""
    def named(text: str) -> set[str]:
        return {v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text)}

    needed, open_ = set(), named(sql)
    while open_:
        needed |= open_
        open_ = set().union(*(named(VIEWS[v]) for v in open_)) - needed
    heads = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in needed)
    # A statement may bring CTEs of its own.
    if sql.lstrip().upper().startswith("WITH "):
        sql = sql.lstrip()[5:]
        return f"WITH {heads},\n{sql}" if heads else f"WITH {sql}"
    return f"WITH {heads}\n{sql}" if heads else sql
