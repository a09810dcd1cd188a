"""DuckDB SQL of the reports over ``dim_log``, ``fact`` and ``ent``."""

from __future__ import annotations

from oracles.prelude import UP_TO_ENTITIES

# Joined views of the reports; the log's own result is resultado_log.
VIEWS = UP_TO_ENTITIES.rstrip() + """,
p AS (SELECT * FROM dim_log WHERE {where}),
pr AS (SELECT p.log_id, p.protocolo, p.data_evento, p.contratante, p.funcionalidade, p.status_geral,
         p.resultado_operacional AS resultado_log, r.* EXCLUDE (log_id) FROM p JOIN fact r ON r.log_id = p.log_id),
pl AS (SELECT p.log_id, p.protocolo, p.data_evento, p.contratante, p.funcionalidade, p.status_geral,
         p.resultado_operacional AS resultado_log, r.* EXCLUDE (log_id) FROM p LEFT JOIN fact r ON r.log_id = p.log_id),
pe AS (SELECT pr.*, e.entidade_id, e.entidade_tipo, e.entidade_valor FROM pr JOIN ent e ON e.rejeicao_id = pr.rejeicao_id),
var AS (SELECT count(DISTINCT date_trunc('day', data_evento)) AS dias, count(DISTINCT date_trunc('hour', data_evento)) AS horas,
         date_diff('day', min(data_evento), max(data_evento)) AS intervalo_dias FROM p)
"""
ERR = "status_geral = 'ERRO'"
NEG = "resultado_operacional = 'REJEICAO_NEGOCIO'"
EVITABLE = "('PLACA', 'LOCALIZAÇÃO', 'CARGA', 'VALIDAÇÃO', 'DATA', 'JANELA OPERACIONAL', 'TOLERÂNCIA')"


def sev(alias: str = "", condition: str = "TRUE") -> str:
    names = (("CRITICO", "criticos"), ("ALTO", "altos"), ("MEDIO", "medios"), ("BAIXO", "baixos"))
    return ", ".join(f"count(CASE WHEN severidade = '{s}' AND {condition} THEN 1 END) AS {n}" for s, n in names)


SCORE = "greatest(0.0::DOUBLE, 100.0::DOUBLE - ((criticos * 1.0::DOUBLE + altos * 0.5::DOUBLE + medios * 0.2::DOUBLE + baixos * 0.1::DOUBLE) / {0}) * 100.0)"
COUNTS = f"""counts AS (SELECT count(*) AS total_requests, count(CASE WHEN status_geral = 'SUCESSO' THEN 1 END) AS count_sucesso,
  count(CASE WHEN {ERR} THEN 1 END) AS count_erro, {sev(condition=ERR)},
  count(CASE WHEN {ERR} AND categoria_operacional IN {EVITABLE} THEN 1 END) AS count_evitavel,
  count(CASE WHEN {ERR} AND rejeicao_id IS NOT NULL THEN 1 END) AS total_rejeicoes,
  count(DISTINCT protocolo) AS unique_protocols, count(DISTINCT contratante) AS total_contratantes,
  (SELECT count(*) FROM (SELECT contratante FROM p WHERE {ERR} GROUP BY 1 HAVING count(log_id) >= 3)) AS clientes_afetados
  FROM pl)"""


def pct(part: str, whole: str, digits: int = 6) -> str:
    return f"round({part} * 100.0::DOUBLE / nullif({whole}, 0), {digits})"


def leading(source: str, key: str, value: str, alias: str) -> str:
    return (f"(SELECT {key}, {value} AS {alias} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY count(*) DESC, {value} ASC NULLS LAST) AS rn FROM {source} GROUP BY 1, 2) WHERE rn = 1)")


def top_category() -> str:
    return f"""tc AS (SELECT categoria_operacional, count(*) AS erros, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentual
      FROM pr WHERE {ERR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


TF = f"""tf AS (SELECT funcionalidade, count(*) AS erros, {pct('count(*)', f'(SELECT count(*) FROM pl WHERE {ERR})')} AS percentual
  FROM p WHERE {ERR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
T2 = f"""t2 AS (SELECT count(*) AS clientes, sum(erros)::BIGINT AS erros, {pct('sum(erros)', f'(SELECT count(*) FROM pl WHERE {ERR})')} AS percentual
  FROM (SELECT contratante, count(DISTINCT protocolo) AS erros FROM p WHERE {ERR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2))"""
KPIS = f"""SELECT *, round({SCORE.format('total_requests')}, 6) AS score_operacional, {pct('count_sucesso', 'total_requests')} AS taxa_sucesso,
  {pct('count_evitavel', 'count_erro')} AS taxa_evitabilidade FROM counts"""
TRIPLES = f"""triples AS (SELECT funcionalidade, coalesce(tipo_rejeicao_semantica, tipo_erro_tecnico, 'OUTROS_NAO_CATEGORIZADO') AS tipo_rejeicao,
  causa_raiz, count(*) AS volume FROM pr WHERE {ERR} AND coalesce(tipo_rejeicao_semantica, '') NOT IN ('SUCESSO_GERACAO', 'SUCESSO_INSERCAO', 'SUCESSO')
  GROUP BY 1, 2, 3)"""


def _group(column: str, n: int, name: str) -> str:
    return (f"CASE WHEN {column} IN (SELECT {column} FROM triples WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY sum(volume) DESC, 1 LIMIT {n}) "
            f"THEN {column} ELSE 'OUTROS' END AS {name}")


GROUPED = f"""{TRIPLES}, flow AS (SELECT func_grupo, tipo_grupo, causa_grupo, sum(volume)::BIGINT AS volume FROM
  (SELECT {_group('funcionalidade', 5, 'func_grupo')}, {_group('tipo_rejeicao', 7, 'tipo_grupo')}, {_group('causa_raiz', 5, 'causa_grupo')}, volume FROM triples)
  GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 20)"""
CLASS = f"""CASE WHEN categoria_operacional IN {EVITABLE} THEN 'Evitável (Dados/Cadastro)'
  WHEN categoria_operacional IN ('TRANSPORTADOR', 'PAGAMENTO', 'CIOT') THEN 'Parcialmente Evitável (Processo)'
  WHEN categoria_operacional IN ('INTEGRAÇÃO', 'INTEGRACAO', 'SISTEMA') THEN 'Não Evitável (Integração/Sistema)'
  ELSE 'Não Classificado' END"""
DESCRIPTION = """CASE classe_evitabilidade WHEN 'Evitável (Dados/Cadastro)' THEN 'Evitável: Erros causados por dados incorretos ou inconsistências cadastrais.'
  WHEN 'Parcialmente Evitável (Processo)' THEN 'Parcialmente Evitável: Rejeições cadastrais do transportador ou do RNTRC.'
  WHEN 'Não Evitável (Integração/Sistema)' THEN 'Não Evitável: Instabilidade, timeouts ou falhas de rede da ANTT.'
  ELSE 'Não Classificado: Outras mensagens sem categorização de evitabilidade definida.' END"""


def _has(kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM ent e WHERE e.rejeicao_id = pl.rejeicao_id AND e.entidade_tipo IN ({kinds}))"


def _quality(name: str, hit: str, functions: str) -> str:
    x = f"count(CASE WHEN ({hit}) AND {ERR} THEN 1 END)"
    y = f"count(CASE WHEN funcionalidade IN ({functions}) THEN 1 END)"
    return (f"SELECT '{name}' AS dominio, {x} AS erros, {y} AS operacoes, CASE WHEN {y} > 0 THEN "
            f"round(greatest(0.0::DOUBLE, (1.0::DOUBLE - {x} / {y}::DOUBLE) * 100.0), 6) END AS qualidade FROM pl")


ISSUE, LOOK = "'Emitir CIOT', 'Retificar CIOT'", "'Emitir CIOT', 'Retificar CIOT', 'Consultar CIOT'"
QUALITY = " UNION ALL ".join((
    _quality("PLACA", "categoria_operacional = 'PLACA'", ISSUE),
    _quality("RNTRC", "(categoria_operacional = 'TRANSPORTADOR' OR tipo_rejeicao_semantica IN ('TRANSPORTADOR_NAO_ENCONTRADO', 'RNTRC_INATIVO')) AND " + _has("'RNTRC'"), LOOK),
    _quality("CEP", "(categoria_operacional IN ('GEOLOCALIZACAO', 'LOCALIZAÇÃO') OR tipo_rejeicao_semantica IN ('LOCALIZACAO_ORIGEM_INVALIDA', 'CEP_NAO_CADASTRADO')) AND " + _has("'CEP'"), ISSUE),
    _quality("MUNICIPIO", "(categoria_operacional IN ('GEOLOCALIZACAO', 'LOCALIZAÇÃO') OR tipo_rejeicao_semantica IN ('MUNICIPIO_DESTINO_INVALIDO', 'MUNICIPIO_INVALIDO')) AND " + _has("'MUNICIPIO'"), ISSUE),
    _quality("CPF_CNPJ", "(categoria_operacional = 'TRANSPORTADOR' OR tipo_rejeicao_semantica = 'TRANSPORTADOR_NAO_ENCONTRADO') AND " + _has("'CPF', 'CNPJ', 'DOC'"), LOOK),
))
ENT_TEXT = "coalesce((SELECT string_agg(e.entidade_tipo || ':' || e.entidade_valor, ' | ' ORDER BY e.entidade_tipo || ':' || e.entidade_valor) FROM ent e WHERE e.rejeicao_id = pl.rejeicao_id), '')"
DETAIL = f"""SELECT protocolo, data_evento AS data, contratante, funcionalidade, status_geral, resultado_log AS resultado_operacional, codigo_antt,
  tipo_rejeicao_semantica, tipo_erro_tecnico, causa_raiz, orientacao_operacional, {ENT_TEXT} AS entidades_extraidas,
  coalesce(mensagem_original, 'Operação concluída com sucesso') AS mensagem_original, severidade, categoria_operacional AS categoria,
  (CASE severidade WHEN 'CRITICO' THEN -1.0 WHEN 'ALTO' THEN -0.5 WHEN 'MEDIO' THEN -0.2 WHEN 'BAIXO' THEN -0.1 ELSE 0.0 END)::DOUBLE AS score,
  subtipo_rejeicao AS rejeicao_oficial, mensagem_normalizada AS template_normalizado, log_id AS hash_evento FROM pl"""
SEARCH = ("(protocolo LIKE '%{0}%' OR mensagem_original ILIKE '%{0}%' OR EXISTS (SELECT 1 FROM ent e "
          "WHERE e.rejeicao_id = pl.rejeicao_id AND e.entidade_valor LIKE '%{0}%'))")


def critical(kinds: str, value: str = "") -> str:
    cond = f"entidade_tipo IN ({kinds})" + (f" AND entidade_valor LIKE '%{value}%'" if value else "")
    return f"""SELECT b.entidade, quantidade_rejeicoes, quantidade_clientes, principal_rejeicao, principal_funcionalidade FROM
      (SELECT entidade_valor AS entidade, count(DISTINCT protocolo) AS quantidade_rejeicoes, count(DISTINCT contratante) AS quantidade_clientes
       FROM pe WHERE {cond} AND {NEG} GROUP BY 1) b
      LEFT JOIN {leading(f"(SELECT *, entidade_valor AS entidade FROM pe WHERE {cond} AND {NEG})", 'entidade', 'tipo_rejeicao_semantica', 'principal_rejeicao')} t ON t.entidade = b.entidade
      LEFT JOIN {leading(f"(SELECT *, entidade_valor AS entidade FROM pe WHERE {cond} AND {NEG})", 'entidade', 'funcionalidade', 'principal_funcionalidade')} f ON f.entidade = b.entidade"""


def consolidated(search: str = "") -> str:
    where = f"WHERE mensagem_normalizada ILIKE '%{search}%' OR funcionalidade ILIKE '%{search}%'" if search else ""
    return f"""(SELECT strftime(dia, '%d/%m/%Y') AS data, funcionalidade, mensagem_normalizada, quantidade, representatividade FROM
      (SELECT data_evento::DATE AS dia, funcionalidade, coalesce(nullif(mensagem_normalizada, ''), 'Erro de sistema ou resposta vazia') AS mensagem_normalizada,
        count(*) AS quantidade, {pct('count(*)', 'sum(count(*)) OVER ()', 3)} AS representatividade FROM pr WHERE {ERR} GROUP BY 1, 2, 3) {where})"""


MATRIX = f"""m AS (SELECT contratante, tipo_rejeicao_semantica, count(*) AS total FROM pr WHERE {NEG} AND contratante IS NOT NULL
  AND tipo_rejeicao_semantica IS NOT NULL GROUP BY 1, 2), mm AS (SELECT * FROM m
  WHERE contratante IN (SELECT contratante FROM m GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT {{0}})
  AND tipo_rejeicao_semantica IN (SELECT tipo_rejeicao_semantica FROM m GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT {{1}}))"""

GATE = "(SELECT dias > 1 OR horas >= 4 FROM var)"

# name -> (extra CTEs, query)
REPORTS: dict[str, tuple[str, str]] = {
    "executive_kpis": (COUNTS, KPIS),
    "top_category": (top_category(), "SELECT * FROM tc"),
    "top_functionality": (TF, "SELECT * FROM tf"),
    "top2_client_share": (T2, "SELECT * FROM t2"),
    "executive_insights": (f"{COUNTS}, {top_category()}, {TF}, {T2}", f"""SELECT (SELECT categoria_operacional FROM tc) AS top_categoria,
        (SELECT percentual FROM tc) AS top_categoria_pct, (SELECT funcionalidade FROM tf) AS top_funcionalidade,
        (SELECT percentual FROM tf) AS top_funcionalidade_pct, {pct('count_evitavel', 'count_erro')} AS taxa_evitabilidade,
        (SELECT clientes FROM t2) AS top_clientes, (SELECT percentual FROM t2) AS top_clientes_pct FROM counts"""),
    "top_clients": ("", f"""SELECT c.contratante, total_rejeicoes, percentual, score_operacional, principal_rejeicao, principal_funcionalidade FROM
        (SELECT contratante, count(DISTINCT protocolo) AS total_rejeicoes, {pct('count(DISTINCT protocolo)', 'sum(count(DISTINCT protocolo)) OVER ()')} AS percentual
         FROM p WHERE {ERR} GROUP BY 1) c
        JOIN (SELECT contratante, round({SCORE.format('linhas')}, 6) AS score_operacional FROM
          (SELECT contratante, count(*) AS linhas, {sev(condition=ERR)} FROM pl GROUP BY 1)) s ON s.contratante = c.contratante
        LEFT JOIN {leading(f'(SELECT * FROM pr WHERE {ERR})', 'contratante', 'tipo_rejeicao_semantica', 'principal_rejeicao')} t ON t.contratante = c.contratante
        LEFT JOIN {leading(f'(SELECT * FROM pr WHERE {ERR})', 'contratante', 'funcionalidade', 'principal_funcionalidade')} f ON f.contratante = c.contratante
        ORDER BY total_rejeicoes DESC, c.contratante LIMIT 10"""),
    "top_rejections": ("", f"""SELECT tipo_rejeicao_semantica, count(*) AS volume, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentual
        FROM pr WHERE {ERR} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10"""),
    "problem_functionalities": ("", f"""SELECT m.funcionalidade, total_erros, {pct('total_erros', 'chamadas')} AS taxa_erro,
        coalesce(rejeicao, 'Nenhuma') AS principal_rejeicao, coalesce(gravidade, 'INFO') AS severidade_predominante FROM
        (SELECT funcionalidade, count(*) AS chamadas, count(CASE WHEN {ERR} THEN 1 END) AS total_erros FROM p GROUP BY 1) m
        LEFT JOIN {leading(f'(SELECT * FROM pr WHERE {ERR})', 'funcionalidade', 'tipo_rejeicao_semantica', 'rejeicao')} t ON t.funcionalidade = m.funcionalidade
        LEFT JOIN {leading(f'(SELECT * FROM pr WHERE {ERR})', 'funcionalidade', 'severidade', 'gravidade')} s ON s.funcionalidade = m.funcionalidade
        WHERE total_erros > 0"""),
    "severity_heatmap": ("", "SELECT funcionalidade, " + ", ".join(
        f"count(CASE WHEN severidade = '{s}' THEN rejeicao_id END) AS \"{s}\"" for s in ("BAIXO", "MEDIO", "ALTO", "CRITICO"))
        + f" FROM pr WHERE {ERR} AND funcionalidade IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10"),
    "evitability": ("", f"""SELECT classe_evitabilidade, total, percentual, {DESCRIPTION} AS descricao FROM (SELECT {CLASS} AS classe_evitabilidade,
        count(*) AS total, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentual FROM pr WHERE {ERR} GROUP BY 1)"""),
    "data_quality": ("", QUALITY),
    "flow_triples": (TRIPLES, "SELECT * FROM triples"),
    "flow_grouped": (GROUPED, "SELECT * FROM flow"),
    "flow_links": (GROUPED, """SELECT 'FUNC_TIPO' AS nivel, func_grupo AS origem, tipo_grupo AS destino, sum(volume)::BIGINT AS volume FROM flow GROUP BY 1, 2, 3
        UNION ALL SELECT 'TIPO_CAUSA', tipo_grupo, causa_grupo, sum(volume)::BIGINT FROM flow GROUP BY 1, 2, 3"""),
    "temporal_variability": ("", "SELECT dias, horas, intervalo_dias, dias > 1 OR horas >= 4 AS variavel FROM var"),
    "error_timeseries": ("", f"""SELECT CASE WHEN (SELECT intervalo_dias FROM var) <= 3 THEN strftime(data_evento, '%Y-%m-%d %H:00')
        ELSE strftime(data_evento, '%Y-%m-%d') END AS periodo, categoria_operacional AS categoria, count(*) AS total FROM pr WHERE {ERR} AND {GATE} GROUP BY 1, 2"""),
    "client_list": ("", "SELECT DISTINCT contratante FROM p"),
    "client_scorecard": ("", f"""SELECT *, round({SCORE.format('total')}, 6) AS score, round((1.0::DOUBLE - erros_cadastro / total::DOUBLE) * 100.0, 6) AS perc_controlavel FROM
        (SELECT t.contratante, t.total, coalesce(criticos, 0) AS criticos, coalesce(altos, 0) AS altos, coalesce(medios, 0) AS medios, coalesce(baixos, 0) AS baixos,
          coalesce(rejeicoes_negocio, 0) AS rejeicoes_negocio, coalesce(erros_tecnicos, 0) AS erros_tecnicos, coalesce(erros_cadastro, 0) AS erros_cadastro
         FROM (SELECT contratante, count(*) AS total FROM p GROUP BY 1) t LEFT JOIN (SELECT contratante, {sev()},
          count(CASE WHEN {NEG} THEN 1 END) AS rejeicoes_negocio, count(CASE WHEN resultado_operacional IN ('ERRO_TECNICO', 'ERRO_INFRAESTRUTURA') THEN 1 END) AS erros_tecnicos,
          count(CASE WHEN {NEG} AND categoria_operacional IN ('TRANSPORTADOR', 'GEOLOCALIZACAO', 'PLACA') THEN 1 END) AS erros_cadastro FROM pr GROUP BY 1) r
         ON r.contratante = t.contratante)"""),
    "client_recurrent_entities": ("", f"""SELECT contratante, entidade_tipo, entidade_valor, total_falhas, rejeicao_predominante FROM
        (SELECT *, row_number() OVER (PARTITION BY contratante ORDER BY total_falhas DESC, entidade_tipo, entidade_valor) AS rn FROM
         (SELECT contratante, entidade_tipo, entidade_valor, count(*) AS total_falhas, max(tipo_rejeicao_semantica) AS rejeicao_predominante
          FROM pe WHERE {NEG} GROUP BY 1, 2, 3)) WHERE rn <= 8"""),
    "client_error_categories": ("", f"SELECT contratante, categoria_operacional, count(*) AS volume FROM pr WHERE {NEG} GROUP BY 1, 2"),
    "corrective_actions": ("", f"""SELECT contratante, categoria_operacional, tipo_rejeicao_semantica, subtipo_rejeicao, orientacao_operacional,
        count(*) AS ocorrencias, max(mensagem) AS exemplo FROM pr WHERE {NEG} GROUP BY 1, 2, 3, 4, 5"""),
    "critical_entities_rntrc": ("", critical("'RNTRC'")),
    "critical_entities_placa": ("", critical("'PLACA'")),
    "critical_entities_doc": ("", critical("'CPF', 'CNPJ', 'DOC'")),
    "critical_entities_cep_mun": ("", critical("'CEP', 'MUNICIPIO'")),
    "critical_entities_search": ("", critical("'PLACA'", "C01")),
    "critical_entities_page": ("", "SELECT * FROM (" + critical("'PLACA'") + ") ORDER BY quantidade_rejeicoes DESC, entidade LIMIT 10 OFFSET 10"),
    "top_entities": ("", f"SELECT entidade_valor, count(*) AS total FROM pe WHERE {NEG} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "entity_trend": ("", f"""SELECT strftime(data_evento, '%Y-%m-%d') AS dia, entidade_valor AS entidade, count(*) AS total_falhas FROM pe WHERE {NEG} AND {GATE}
        AND entidade_valor IN (SELECT entidade_valor FROM pe WHERE {NEG} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1, 2"""),
    "client_rejection_matrix": (MATRIX.format(20, 15), "SELECT * FROM mm"),
    # A view needs the names of its columns: the business types that the derived logs bring about.
    "client_rejection_crosstab": (MATRIX.format(20, 15), """SELECT contratante, coalesce(COLUMNS(* EXCLUDE (contratante)), 0)::BIGINT
        FROM (PIVOT mm ON tipo_rejeicao_semantica IN ('LOCALIZACAO_ORIGEM_INVALIDA', 'MUNICIPIO_DESTINO_INVALIDO', 'OPERACAO_JA_CANCELADA', 'OUTROS_NAO_CATEGORIZADO',
        'PAGAMENTO_TAC_NAO_PERMITIDO', 'PLACA_SEM_VINCULO_RNTRC', 'QUANTIDADE_EIXOS_INVALIDA', 'TRANSPORTADOR_NAO_ENCONTRADO') USING sum(total) GROUP BY contratante)"""),
    "uncatalogued_codes": ("", """SELECT codigo_antt, funcionalidade, max(mensagem_original) AS exemplo, count(*) AS quantidade, min(data_evento) AS primeira_ocorrencia,
        max(data_evento) AS ultima_ocorrencia FROM pr WHERE tipo_rejeicao_semantica = 'OUTROS_NAO_CATEGORIZADO' AND codigo_antt <> '' GROUP BY 1, 2"""),
    "hourly_errors": ("", "SELECT date_trunc('hour', data_evento) AS hora, count(*) AS total_erros FROM pr GROUP BY 1"),
    "traffic_anomalies": ("h AS (SELECT date_trunc('hour', data_evento) AS hora, count(*) AS total_erros FROM pr GROUP BY 1)",
        f"SELECT * FROM h WHERE {GATE} AND (SELECT count(*) FROM h) > 2 AND total_erros > (SELECT avg(total_erros) + 2 * stddev_samp(total_erros) FROM h)"),
    "detail_count": ("", "SELECT count(*) AS total FROM pl"),
    "detail_page": ("", f"{DETAIL} ORDER BY data_evento DESC, log_id, rejeicao_id NULLS LAST LIMIT 50 OFFSET 50"),
    "detail_page_after": ("", f"{DETAIL} ORDER BY data_evento DESC, log_id, rejeicao_id NULLS LAST LIMIT 50 OFFSET 50"),
    "text_search": ("", f"{DETAIL} WHERE {SEARCH.format('1200004')}"),
    "text_search_message": ("", f"{DETAIL} WHERE {SEARCH.format('PLACA abc-00')}"),
    "detail_local_filters": ("", f"{DETAIL} WHERE funcionalidade = 'Emitir CIOT' AND tipo_rejeicao_semantica = 'PLACA_SEM_VINCULO_RNTRC' AND contratante = 'CLI7'"),
    "export_rows": ("", f"""SELECT protocolo, data_evento AS data, contratante, funcionalidade, status_geral, resultado_log AS resultado_operacional, tipo_rejeicao_semantica,
        tipo_erro_tecnico, coalesce(mensagem_original, 'Operação concluída com sucesso') AS mensagem_original,
        coalesce(mensagem_normalizada, 'Operação concluída com sucesso') AS mensagem_normalizada,
        CASE WHEN status_geral = 'SUCESSO' THEN 'SIM' ELSE 'NÃO' END AS indicador_sucesso, coalesce(severidade, 'INFO') AS severidade_operacional,
        coalesce(codigo_antt, '') AS codigo_antt, CASE WHEN resultado_log IN ('SUCESSO', 'SUCESSO_COM_ALERTA') THEN 'Sucesso Operacional' ELSE 'Erro/Falha' END AS contexto_operacional,
        rejeicao_id, CASE WHEN rejeicao_id IS NOT NULL THEN log_id END AS log_id, template_oficial, subtipo_rejeicao AS mensagem_padrao,
        categoria_operacional AS categoria_oficial, causa_raiz, orientacao_operacional, {ENT_TEXT} AS entidades_extraidas FROM pl"""),
    "filter_domain": ("", """SELECT 'data_min' AS campo, strftime(min(data_evento), '%Y-%m-%d') AS valor FROM p UNION ALL SELECT 'data_max', strftime(max(data_evento), '%Y-%m-%d') FROM p
        UNION ALL SELECT DISTINCT 'contratante', contratante FROM p UNION ALL SELECT DISTINCT 'funcionalidade', funcionalidade FROM p
        UNION ALL SELECT DISTINCT 'causa_raiz', causa_raiz FROM fact WHERE causa_raiz IS NOT NULL
        UNION ALL SELECT DISTINCT 'tipo_rejeicao_semantica', tipo_rejeicao_semantica FROM fact WHERE tipo_rejeicao_semantica IS NOT NULL
        UNION ALL SELECT DISTINCT 'codigo_antt', codigo_antt FROM fact WHERE codigo_antt <> ''"""),
    "consolidated_rejections": ("", f"SELECT * FROM {consolidated()}"),
    "consolidated_search": ("", f"SELECT * FROM {consolidated('rntrc')}"),
    "consolidated_page": ("", f"""SELECT * FROM {consolidated()} ORDER BY strptime(data, '%d/%m/%Y') DESC, quantidade DESC, funcionalidade, mensagem_normalizada
        LIMIT 15 OFFSET 15"""),
    "consolidated_totals": ("", f"SELECT sum(quantidade)::BIGINT AS total_quantidade, count(*) AS total_linhas FROM {consolidated()}"),
}

CAUSE = "log_id IN (SELECT log_id FROM fact WHERE causa_raiz IN ('LOCALIZAÇÃO', 'PLACA'))"
# name -> predicate over dim_log
FILTERS = {
    "filter_period": "data_evento BETWEEN '2024-01-05 00:00:00' AND '2024-01-09 23:59:59'",
    "filter_single_day": "data_evento BETWEEN '2024-01-05 00:00:00' AND '2024-01-05 23:59:59'",
    "filter_protocol": "protocolo LIKE '%0_12%'",
    "filter_status": "status_geral = 'SUCESSO'",
    "filter_client": "contratante IN ('CLI3', 'CLI17')",
    "filter_functionality": "funcionalidade IN ('Emitir CIOT', 'Cancelar CIOT')",
    "filter_cause": CAUSE,
    "filter_type": "log_id IN (SELECT log_id FROM fact WHERE tipo_rejeicao_semantica IN ('PLACA_SEM_VINCULO_RNTRC'))",
    "filter_code": "log_id IN (SELECT log_id FROM fact WHERE codigo_antt IN ('209', '999'))",
    "filter_message": "log_id IN (SELECT log_id FROM fact WHERE mensagem ILIKE '%MUNICÍPIO%')",
    "filter_combined": "data_evento BETWEEN '2024-01-03 00:00:00' AND '2024-01-20 23:59:59' AND status_geral = 'ERRO'"
                       " AND funcionalidade IN ('Emitir CIOT', 'Cancelar CIOT') AND " + CAUSE,
}


def report_sql(name: str, where: str = "1 = 1") -> str:
    ctes, query = REPORTS[name]
    head = VIEWS.replace("{where}", where).rstrip()
    return head + (",\n" + ctes if ctes else "") + "\n" + query


def filter_sql(name: str) -> str:
    return UP_TO_ENTITIES + f"SELECT log_id, protocolo, status_geral FROM dim_log WHERE {FILTERS[name]}"
