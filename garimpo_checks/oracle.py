"""Check SQL: the expected rows of each query, written for DuckDB on its own terms.

Cleaning, rules and reports are stated here a second time, as SQL over the raw roles;
nothing is shared with the Spark code but the fixed result texts.
"""

from __future__ import annotations

import re

from garimpo_checks import roles
from garimpo_checks.spark_queries import (
    BY_ID,
    BY_TEXT,
    FILTERED,
    IN_MUNICIPALITY,
    LOOKED_UP,
    OTHER_WEIGHTS,
    PARAMS,
    SECOND_PAGE,
    SHEET_ROWS,
    STATE,
    STORED_PAGE,
)
from garimpo import fixed_values as fv
from garimpo.parameters import ScoreWeights

_NUMERIC = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _number(text: str, kind: str = "DECIMAL(18,2)") -> str:
    return (
        f"CASE WHEN regexp_full_match({text}, {_NUMERIC}) "
        f"THEN TRY_CAST({text} AS {kind}) END"
    )


def _money(text: str) -> str:
    return _number(f"replace(replace({text}, '.', ''), ',', '.')")


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '\\D', '', 'g')"


def _br_amount(amount: str) -> str:
    return f"translate(printf('%,.2f', CAST({amount} AS DOUBLE)), ',.', '.,')"


def _br_whole(number: str) -> str:
    return f"replace(printf('%,d', CAST({number} AS BIGINT)), ',', '.')"


def _br_rounded(amount: str) -> str:
    # Half away from zero on the exact decimal.
    return f"'R$ ' || {_br_whole(f'round(CAST({amount} AS DECIMAL(18,2)), 0)')}"


def _br_date(text: str) -> str:
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN '{fv.EMPTY_MARK}' "
        f"WHEN regexp_full_match(trim({text}), '[0-9]{{8}}') "
        f"THEN regexp_replace(trim({text}), '^(....)(..)(..)$', '\\3/\\2/\\1') "
        f"WHEN regexp_matches(trim({text}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"THEN regexp_replace(left(trim({text}), 10), '^(....)-(..)-(..)$', '\\3/\\2/\\1') "
        f"ELSE trim({text}) END"
    )


def _iso_of_serial(serial: str) -> str:
    return f"CAST(DATE '{fv.SERIAL_DAY_ZERO}' + CAST(trunc({serial}) AS INTEGER) AS VARCHAR)"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _outlook(debt: str, with_unfit: str, debt_only: str) -> str:
    return f"""CASE WHEN {debt} AND inapta THEN '{with_unfit}'
                    WHEN {debt} THEN '{debt_only}'
                    WHEN inapta THEN '{fv.FORECAST_UNFIT}'
                    WHEN suspensa THEN '{fv.FORECAST_SUSPENDED}'
                    ELSE '{fv.FORECAST_CLEAR}' END"""


def _score(weights: ScoreWeights) -> str:
    terms = {
        "tem_divida_ativa_uniao": weights.divida_ativa_uniao,
        "tem_divida_ativa_mg": weights.divida_ativa_mg,
        "situacao_irregular": weights.situacao_irregular,
        "tem_sancao": weights.sancao,
        "saiu_do_simples": weights.saiu_do_simples,
        "coalesce(porte_empresa = '05', FALSE)": weights.porte_demais,
    }
    total = " + ".join(f"{points} * CAST({flag} AS INTEGER)" for flag, points in terms.items())
    return f"CAST(least(100, {total}) AS INTEGER)"


def _inscriptions(label: str, rows: str, amount: str, tail: str = "''") -> str:
    return (
        f"'{label}' || {rows} || if({rows} = 1, '{fv.TEXT_ONE_INSCRIPTION}', "
        f"'{fv.TEXT_MANY_INSCRIPTIONS}') || {_br_amount(amount)} || {tail} || ')'"
    )


_UNIVERSE_COLUMNS = """cnpj_basico, cnpj, razao_social, nome_fantasia,
        identificador_matriz_filial, situacao_cadastral, data_situacao_cadastral,
        motivo_situacao_cadastral, data_inicio_atividade, cnae_fiscal_principal,
        cnae_fiscal_secundaria, uf, municipio_codigo, bairro, cep, email, telefone,
        natureza_juridica, porte_empresa, capital_social, simples_ativo, mei_ativo,
        saiu_do_simples, data_exclusao_simples"""

_LEAD_COLUMNS = """cnpj, cnpj_basico, cnpj_formatado, razao_social, nome_fantasia, municipio,
        uf, bairro, cep, telefone, email, cnae_fiscal_principal, cnae_descricao,
        natureza_descricao, porte, capital_social, situacao, motivo_descricao,
        data_inicio_atividade, regime_provavel, regime_confianca, tem_divida_ativa_uniao,
        dau_qtd_inscricoes, dau_valor_total, dau_ajuizado, dau_categorias,
        tem_divida_ativa_mg, dam_qtd_inscricoes, dam_valor_total, dam_especies,
        situacao_irregular, inapta, suspensa, tem_sancao, sancao_cadastros, sancao_tipos,
        saiu_do_simples, data_exclusao_simples, cnd_federal_prognostico,
        cdt_estadual_mg_prognostico, apontamentos_texto, score, qtd_apontamentos"""

_FINDING_COLUMNS = """cnpj_basico, cnpj, dau_qtd_inscricoes, dau_valor_total, dau_ajuizado,
        dau_categorias, tem_divida_ativa_uniao, dam_qtd_inscricoes, dam_valor_total,
        dam_especies, tem_divida_ativa_mg, situacao_irregular, inapta, suspensa, sancao_qtd,
        sancao_cadastros, sancao_tipos, tem_sancao, saiu_do_simples, data_exclusao_simples,
        cnd_federal_prognostico, cdt_estadual_mg_prognostico, apontamentos_texto"""

_HAS_FINDING = (
    "tem_divida_ativa_uniao OR tem_divida_ativa_mg OR situacao_irregular "
    "OR tem_sancao OR saiu_do_simples"
)

# Company columns that establishments of a company share.
_COMPANY = f"""
    SELECT e.cnpj_basico, e.razao_social, e.natureza_juridica, e.porte_empresa,
           {_number("replace(e.capital_social, ',', '.')", "DOUBLE")} AS capital_social,
           s.simples_ativo, s.mei_ativo, s.saiu_do_simples, s.data_exclusao_simples
    FROM empresas AS e
    LEFT JOIN situacao_simples AS s ON s.cnpj_basico = e.cnpj_basico
    WHERE e.natureza_juridica LIKE '{PARAMS.prefixo_natureza_juridica}%'
      AND s.simples_ativo IS DISTINCT FROM TRUE
      AND s.mei_ativo IS DISTINCT FROM TRUE"""

_ALL_FINDINGS = f"""
    WITH juntos AS (
        SELECT u.* EXCLUDE (saiu_do_simples),
               u.saiu_do_simples IS NOT DISTINCT FROM TRUE AS saiu_do_simples,
               f.cnpj_basico IS NOT NULL AS tem_divida_ativa_uniao,
               coalesce(f.dau_qtd_inscricoes, 0) AS dau_qtd_inscricoes,
               coalesce(f.dau_valor_total, 0.0) AS dau_valor_total,
               coalesce(f.dau_ajuizado, FALSE) AS dau_ajuizado,
               f.dau_categorias,
               m.cnpj_basico IS NOT NULL AS tem_divida_ativa_mg,
               coalesce(m.dam_qtd_inscricoes, 0) AS dam_qtd_inscricoes,
               coalesce(m.dam_valor_total, 0.0) AS dam_valor_total,
               m.dam_especies,
               s.cnpj_basico IS NOT NULL AS tem_sancao,
               coalesce(s.sancao_qtd, 0) AS sancao_qtd,
               s.sancao_cadastros,
               s.sancao_tipos,
               u.situacao_cadastral <> '02' AS situacao_irregular,
               u.situacao_cadastral = '04' AS inapta,
               u.situacao_cadastral = '03' AS suspensa
        FROM @universe AS u
        LEFT JOIN soma_uniao AS f ON f.cnpj_basico = u.cnpj_basico
        LEFT JOIN soma_mg AS m ON m.cnpj_basico = u.cnpj_basico
        LEFT JOIN soma_sancoes AS s ON s.cnpj_basico = u.cnpj_basico
    )
    SELECT *,
           {_outlook("tem_divida_ativa_uniao", fv.FORECAST_FEDERAL_DEBT_UNFIT,
                     fv.FORECAST_FEDERAL_DEBT)} AS cnd_federal_prognostico,
           {_outlook("tem_divida_ativa_mg", fv.FORECAST_STATE_DEBT_UNFIT,
                     fv.FORECAST_STATE_DEBT)} AS cdt_estadual_mg_prognostico,
           concat_ws('{fv.FINDING_SEPARATOR}',
               if(tem_divida_ativa_uniao, {_inscriptions(
                   fv.TEXT_FEDERAL_DEBT, "dau_qtd_inscricoes", "dau_valor_total")}, NULL),
               if(dau_ajuizado, '{fv.TEXT_SUED}', NULL),
               if(tem_divida_ativa_mg, {_inscriptions(
                   fv.TEXT_STATE_DEBT, "dam_qtd_inscricoes", "dam_valor_total",
                   f"coalesce('{fv.TEXT_DASH}' || dam_especies, '')")}, NULL),
               if(inapta, concat('{fv.TEXT_UNFIT}', '{fv.TEXT_DASH}' || motivo_descricao), NULL),
               if(suspensa, concat('{fv.TEXT_SUSPENDED}',
                                   '{fv.TEXT_DASH}' || motivo_descricao), NULL),
               if(tem_sancao, '{fv.TEXT_SANCTION}' || sancao_cadastros, NULL),
               if(saiu_do_simples, '{fv.TEXT_LEFT_SIMPLES}' || coalesce(
                   strftime(strptime(data_exclusao_simples, '%Y%m%d'), '%d/%m/%Y'),
                   '{fv.TEXT_UNKNOWN_DATE}'), NULL)) AS apontamentos_texto
    FROM juntos"""

# Regime and confidence as a pair.
_REGIME = f"""CASE
        WHEN left(cnae_fiscal_principal, 4) IN {_in(fv.MANDATORY_LUCRO_REAL_ACTIVITIES)}
        THEN ['{fv.REGIME_MANDATORY}', '{fv.CONFIDENCE_HIGH}']
        WHEN porte_empresa = '05'
        THEN [if(coalesce(capital_social, 0) >= {PARAMS.capital_lucro_real},
                 '{fv.REGIME_REAL}', '{fv.REGIME_PRESUMED}'), '{fv.CONFIDENCE_MEDIUM}']
        WHEN porte_empresa IN ('01', '03')
        THEN ['{fv.REGIME_PRESUMED_SMALL}', '{fv.CONFIDENCE_LOW}']
        ELSE ['{fv.REGIME_UNKNOWN}', '{fv.CONFIDENCE_NONE}'] END"""

_ALL_LEADS = f"""
    SELECT *,
           regexp_replace(cnpj, '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5')
               AS cnpj_formatado,
           MAP {{'00': 'Não informado', '01': 'Microempresa',
                 '03': 'Empresa de pequeno porte', '05': 'Demais'}}[porte_empresa] AS porte,
           MAP {{'02': 'Ativa', '03': 'Suspensa', '04': 'Inapta'}}[situacao_cadastral]
               AS situacao,
           ({_REGIME})[1] AS regime_provavel,
           ({_REGIME})[2] AS regime_confianca,
           {_score(PARAMS.weights)} AS score,
           {_score(OTHER_WEIGHTS.weights)} AS outro_score,
           CAST(tem_divida_ativa_uniao AS INTEGER) + CAST(tem_divida_ativa_mg AS INTEGER)
               + CAST(situacao_irregular AS INTEGER) + CAST(tem_sancao AS INTEGER)
               + CAST(saiu_do_simples AS INTEGER) AS qtd_apontamentos
    FROM @findings"""


def _universe(kind: str) -> str:
    return f"""
    SELECT c.*, u.* EXCLUDE (cnpj_basico)
    FROM unidades AS u
    JOIN empresas_fora_do_simples AS c ON c.cnpj_basico = u.cnpj_basico
    WHERE {kind}"""


def _described(base: str) -> str:
    return f"""
    SELECT b.*, mu.descricao AS municipio, ca.descricao AS cnae_descricao,
           na.descricao AS natureza_descricao, mo.descricao AS motivo_descricao
    FROM {base} AS b
    LEFT JOIN municipios AS mu ON mu.codigo = b.municipio_codigo
    LEFT JOIN cnaes AS ca ON ca.codigo = b.cnae_fiscal_principal
    LEFT JOIN naturezas AS na ON na.codigo = b.natureza_juridica
    LEFT JOIN motivos AS mo ON mo.codigo = b.motivo_situacao_cadastral"""


CTES: dict[str, str] = {
    **{name: roles.check_sql(name) for name in roles.ROLES},
    # --- cleaning ---
    "divida_uniao": f"""
    SELECT {_digits("cpf_cnpj")} AS cpf_cnpj, left({_digits("cpf_cnpj")}, 8) AS cnpj_basico,
           * EXCLUDE (cpf_cnpj, valor_consolidado, categoria),
           {_money("valor_consolidado")} AS valor_consolidado, categoria
    FROM divida_bruta
    WHERE length({_digits("cpf_cnpj")}) = 14""",
    "sancoes_limpas": f"""
    SELECT {_digits("cpf_cnpj")} AS cpf_cnpj, left({_digits("cpf_cnpj")}, 8) AS cnpj_basico,
           cadastro, nome, tipo_sancao, data_inicio, data_fim, orgao_sancionador, uf,
           fundamentacao
    FROM sancoes_brutas
    WHERE length({_digits("cpf_cnpj")}) = 14""",
    "divida_mg_numerada": f"""
    SELECT * REPLACE ({_number("data_serial", "DOUBLE")} AS data_serial) FROM divida_mg_bruta""",
    "divida_mg": f"""
    SELECT {_digits("cpf_cnpj")} AS cpf_cnpj, left({_digits("cpf_cnpj")}, 8) AS cnpj_basico,
           nome_devedor, numero_cda, {_iso_of_serial("data_serial")} AS data_inscricao,
           especie, {_number("saldo_cda")} AS saldo_cda, {_number("saldo_nucleo")} AS saldo_nucleo
    FROM divida_mg_numerada
    WHERE length({_digits("cpf_cnpj")}) = 14
      AND data_serial >= (SELECT date_diff('day', DATE '{fv.SERIAL_DAY_ZERO}',
                                           CAST(max(l_shipdate) AS DATE)) - {PARAMS.janela_dias}
                          FROM lineitem)""",
    "situacao_simples": """
    SELECT cnpj_basico, opcao_pelo_simples, opcao_mei, data_exclusao_simples,
           data_exclusao_mei, data_opcao_simples,
           opcao_pelo_simples = 'S' AND data_exclusao_simples IS NULL AS simples_ativo,
           opcao_mei = 'S' AND data_exclusao_mei IS NULL AS mei_ativo,
           opcao_pelo_simples = 'S' AND data_exclusao_simples IS NOT NULL AS saiu_do_simples
    FROM (SELECT * REPLACE (
              CASE WHEN data_exclusao_simples NOT IN ('0', '00000000')
                   THEN data_exclusao_simples END AS data_exclusao_simples,
              CASE WHEN data_exclusao_mei NOT IN ('0', '00000000')
                   THEN data_exclusao_mei END AS data_exclusao_mei,
              CASE WHEN data_opcao_simples NOT IN ('0', '00000000')
                   THEN data_opcao_simples END AS data_opcao_simples)
          FROM simples)""",
    # --- universe ---
    "empresas_fora_do_simples": _COMPANY,
    "unidades": """
    SELECT cnpj_basico, concat(cnpj_basico, cnpj_ordem, cnpj_dv) AS cnpj,
           CASE WHEN nome_fantasia <> '' THEN nome_fantasia END AS nome_fantasia,
           identificador_matriz_filial, situacao_cadastral, data_situacao_cadastral,
           motivo_situacao_cadastral, data_inicio_atividade, cnae_fiscal_principal,
           cnae_fiscal_secundaria, uf, municipio AS municipio_codigo, bairro, cep,
           CASE WHEN correio_eletronico <> '' THEN correio_eletronico END AS email,
           CASE WHEN ddd_1 <> '' AND telefone_1 <> ''
                THEN format('({}) {}', ddd_1, telefone_1) END AS telefone
    FROM estabelecimentos
    WHERE situacao_cadastral IN ('02', '03', '04')""",
    "base_matrizes": _universe("u.identificador_matriz_filial = '1'"),
    "base_todas": _universe("TRUE"),
    "universo": _described("base_matrizes"),
    "universo_todas": _described("base_todas"),
    # --- facts ---
    "soma_uniao": """
    SELECT cnpj_basico, count(*) AS dau_qtd_inscricoes,
           CAST(sum(valor_consolidado) AS DOUBLE) AS dau_valor_total,
           count(DISTINCT categoria) AS dau_qtd_categorias,
           bool_or(coalesce(indicador_ajuizado, '') ILIKE 's%') AS dau_ajuizado,
           string_agg(DISTINCT categoria, ' | ' ORDER BY categoria) AS dau_categorias
    FROM divida_uniao GROUP BY cnpj_basico""",
    "soma_mg": """
    SELECT cnpj_basico, count(*) AS dam_qtd_inscricoes,
           CAST(sum(saldo_cda) AS DOUBLE) AS dam_valor_total,
           string_agg(DISTINCT especie, ' | ' ORDER BY especie) AS dam_especies
    FROM divida_mg GROUP BY cnpj_basico""",
    "soma_sancoes": """
    SELECT cnpj_basico, count(*) AS sancao_qtd,
           string_agg(DISTINCT cadastro, ' | ' ORDER BY cadastro) AS sancao_cadastros,
           string_agg(DISTINCT tipo_sancao, ' | ' ORDER BY tipo_sancao) AS sancao_tipos
    FROM sancoes_limpas GROUP BY cnpj_basico""",
    # --- findings and leads ---
    "apontados": _ALL_FINDINGS.replace("@universe", "universo"),
    "apontados_todas": _ALL_FINDINGS.replace("@universe", "universo_todas"),
    "leads_todos": _ALL_LEADS.replace("@findings", "apontados"),
    "leads_unidades": _ALL_LEADS.replace("@findings", "apontados_todas"),
    "leads": f"SELECT * FROM leads_todos WHERE {_HAS_FINDING}",
    "kpi": "SELECT @kpi FROM leads",
    "kpi_todos": "SELECT @kpi FROM leads_todos",
}

_KPI = """count(*) AS total, count(*) FILTER (qtd_apontamentos > 0) AS com_apontamento,
    count(*) FILTER (tem_divida_ativa_uniao) AS com_divida,
    coalesce(CAST(sum(CAST(dau_valor_total AS DECIMAL(28,2))) AS DOUBLE), 0) AS valor_divida,
    count(*) FILTER (tem_divida_ativa_mg) AS com_divida_mg,
    coalesce(CAST(sum(CAST(dam_valor_total AS DECIMAL(28,2))) AS DOUBLE), 0) AS valor_divida_mg,
    count(*) FILTER (situacao_irregular) AS irregulares,
    count(*) FILTER (tem_sancao) AS sancionadas,
    count(*) FILTER (saiu_do_simples) AS ex_simples,
    count(*) FILTER (starts_with(regime_provavel, 'Lucro Real')) AS lucro_real,
    count(*) FILTER (starts_with(regime_provavel, 'Lucro Presumido')) AS lucro_presumido"""
for _name in ("kpi", "kpi_todos"):
    CTES[_name] = CTES[_name].replace("@kpi", _KPI)


def _with_ctes(query: str, ctes: dict[str, str]) -> str:
    """The query behind the CTEs it needs, in an order that defines before use."""
    done: dict[str, str] = {}

    def need(text: str, me: str = "") -> None:
        for name in ctes:
            if name != me and name not in done and re.search(rf"(FROM|JOIN) {name}\b", text):
                need(ctes[name], name)
                done[name] = ctes[name]

    need(query)
    head = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH {head}\n{query}" if head else query


_DEBT_COLUMNS = """cpf_cnpj, cnpj_basico, tipo_pessoa, tipo_devedor, nome_devedor, uf_devedor,
    unidade_responsavel, numero_inscricao, situacao_inscricao, receita_principal,
    data_inscricao, indicador_ajuizado,
    CAST(valor_consolidado AS DOUBLE) AS valor_consolidado, categoria"""

_ESTABLISHMENTS_READ_BACK = """SELECT * REPLACE (
    nullif(nome_fantasia, '') AS nome_fantasia, nullif(ddd_1, '') AS ddd_1,
    nullif(correio_eletronico, '') AS correio_eletronico) FROM estabelecimentos"""


def _overview(universe_lines: str, kpi: str) -> str:
    """Overview lines; the head differs with the findings cut."""

    def counted(title: str, column: str) -> tuple[str, ...]:
        text = (
            f"{_br_whole(column)} || if(total > 0, printf('  (%.1f%%)', "
            f"100.0 * {column} / total), '')"
        )
        return title, column, "NULL", text

    def amount(title: str, column: str) -> tuple[str, ...]:
        return title, "NULL", column, f"'R$ ' || {_br_amount(column)}"

    def plain(title: str, number: str) -> tuple[str, ...]:
        return title, number, "NULL", _br_whole(number)

    if universe_lines == "cut":
        head = [
            plain(fv.OVERVIEW_UNIVERSE_RAW, "no_universo"),
            plain(fv.OVERVIEW_BECOME_LEADS, "total"),
            plain(fv.OVERVIEW_DISCARDED, "no_universo - total"),
        ]
    else:
        head = [
            counted(fv.OVERVIEW_UNIVERSE_TOTAL, "total"),
            counted(fv.OVERVIEW_WITH_FINDING, "com_apontamento"),
        ]
    lines = [
        *head,
        counted(fv.OVERVIEW_REAL, "lucro_real"),
        counted(fv.OVERVIEW_PRESUMED, "lucro_presumido"),
        counted(fv.OVERVIEW_FEDERAL_DEBT, "com_divida"),
        amount(fv.OVERVIEW_FEDERAL_VALUE, "valor_divida"),
        counted(fv.OVERVIEW_STATE_DEBT, "com_divida_mg"),
        amount(fv.OVERVIEW_STATE_VALUE, "valor_divida_mg"),
        counted(fv.OVERVIEW_IRREGULAR, "irregulares"),
        counted(fv.OVERVIEW_SANCTIONED, "sancionadas"),
        counted(fv.OVERVIEW_LEFT_SIMPLES, "ex_simples"),
    ]
    source = f"(SELECT k.*, (SELECT count(*) FROM universo) AS no_universo FROM {kpi} AS k)"
    return " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS ordem, '{title}' AS indicador, "
        f"CAST({count} AS BIGINT) AS quantidade, CAST({value} AS DOUBLE) AS valor, "
        f"{text} AS texto FROM {source}"
        for n, (title, count, value, text) in enumerate(lines, start=1)
    )


def _place(name_order: str, columns: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {name_order}) AS posicao FROM leads"


def _entries(table: str, columns: str, order: str) -> str:
    return f"""SELECT cnpj_basico, row_number() OVER (
        PARTITION BY cnpj_basico ORDER BY {order}) AS posicao, {columns}
    FROM {table} WHERE cnpj_basico IN (SELECT cnpj_basico FROM leads)"""


def _search(spec_sql: str) -> str:
    return f"SELECT {_LEAD_COLUMNS} FROM leads WHERE {spec_sql}"


_FILTERED = (
    f"score >= {FILTERED.score_minimo} AND regime_provavel LIKE 'Lucro Presumido%' "
    "AND tem_divida_ativa_uniao AND NOT tem_sancao"
)
_SECOND_PAGE = "score >= 0 AND NOT situacao_irregular"

_TAG_TEXTS = [
    ("tem_divida_ativa_uniao", fv.TAG_FEDERAL_DEBT, _br_rounded("dau_valor_total")),
    ("dau_ajuizado", fv.TAG_SUED, "''"),
    ("tem_divida_ativa_mg", fv.TAG_STATE_DEBT, _br_rounded("dam_valor_total")),
    ("inapta", fv.TAG_UNFIT, "''"),
    ("suspensa", fv.TAG_SUSPENDED, "''"),
    ("tem_sancao", fv.TAG_SANCTION, "coalesce(sancao_cadastros, '')"),
    ("saiu_do_simples", fv.TAG_LEFT_SIMPLES, "''"),
]


def _tags() -> str:
    severities = ", ".join(f"if({flag}, '{pair[0]}', NULL)" for flag, pair, _ in _TAG_TEXTS)
    texts = ", ".join(f"if({flag}, '{pair[1]}' || {tail}, NULL)" for flag, pair, tail in _TAG_TEXTS)
    count = " + ".join(f"CAST({flag} AS INTEGER)" for flag, _, _ in _TAG_TEXTS)
    severity, text = fv.TAG_NONE
    return f"""SELECT cnpj, CAST(greatest(1, {count}) AS BIGINT) AS qtd,
        coalesce(nullif(concat_ws(',', {severities}), ''), '{severity}') AS gravidades,
        coalesce(nullif(concat_ws(' / ', {texts}), ''), '{text}') AS textos
    FROM leads_todos"""


_SHARE_NAMES = ("com_apontamento", "com_divida", "com_divida_mg", "irregulares", "sancionadas",
                "ex_simples", "lucro_real", "lucro_presumido")
_TENTHS = "((2000 * valor + total) // (2 * total))"

_SHEET_AMOUNTS = ("capital_social", "dau_valor_total", "dam_valor_total")
_SHEET_TEXT = ", ".join(
    f'CAST(CAST(CAST({name} AS VARCHAR) AS DECIMAL(38,2)) AS VARCHAR) AS "{title}"'
    if name in _SHEET_AMOUNTS
    else f"""nullif(CAST({name} AS VARCHAR), '') AS "{title}\""""
    for name, title in fv.EXPORT_COLUMNS
)
_SHEET = ", ".join(f'{name} AS "{title}"' for name, title in fv.EXPORT_COLUMNS)

_TOP = """SELECT municipio, count(*) AS total,
    count(*) FILTER (qtd_apontamentos > 0) AS com_apontamento
    FROM leads_todos WHERE municipio IS NOT NULL GROUP BY municipio
    ORDER BY total DESC, municipio LIMIT 15"""

_SNAPSHOT_WINDOW = """
    SELECT b.*, (SELECT max(CAST(ts AS DATE)) FROM events) AS hoje FROM sancoes_brutas AS b"""

_QUERIES: dict[str, str] = {
    "scan_positional_csv": "SELECT * FROM empresas",
    "scan_slices": _ESTABLISHMENTS_READ_BACK,
    "scan_filter_uf": f"{_ESTABLISHMENTS_READ_BACK} WHERE uf = '{STATE}'",
    "scan_header_csv": "SELECT * FROM socios",
    "rejected_lines": "SELECT CAST(4 AS INTEGER) AS largura, cnpj_basico || ';A;B;1,00' AS linha "
    "FROM empresas WHERE CAST(cnpj_basico AS BIGINT) % 7 = 0",
    "scan_quoted_break": """SELECT 'carregada' AS destino, cnpj_basico
            || if(CAST(cnpj_basico AS BIGINT) % 7 = 0, ';A' || chr(10) || 'B;1,00', ';A B;1,00')
            AS linha
        FROM empresas""",
    "layout_mismatch": """SELECT '3 columns declared, lines have [3, 4], most of them 4' AS motivo,
        count(*) AS count FROM (
            SELECT right(cnpj_basico, 1) FROM empresas GROUP BY 1
            HAVING count_if(CAST(cnpj_basico AS BIGINT) % 7 >= 2)
                >= 1 + count_if(CAST(cnpj_basico AS BIGINT) % 7 < 2))""",
    "header_aliases": f"SELECT {_DEBT_COLUMNS} FROM divida_uniao",
    "sanction_files": "SELECT * FROM sancoes_limpas",
    "state_debt_cells": "SELECT * FROM divida_mg_bruta",
    "layout_profile": "SELECT CAST(30 AS INTEGER) AS largura, count(*) AS linhas "
    "FROM estabelecimentos",
    "latest_period": "SELECT * FROM pedidos_por_mes QUALIFY "
    "dense_rank() OVER (ORDER BY competencia DESC) = 1",
    "latest_snapshot": f"""SELECT * EXCLUDE (hoje)
        REPLACE (CAST(snapshot_date AS VARCHAR) AS snapshot_date)
        FROM ({_SNAPSHOT_WINDOW})
        WHERE date_diff('day', CAST(snapshot_date AS DATE), hoje) BETWEEN 0 AND 9
        QUALIFY dense_rank() OVER (PARTITION BY cadastro ORDER BY snapshot_date DESC) = 1""",
    "debt_clean": f"SELECT {_DEBT_COLUMNS} FROM divida_uniao "
    f"WHERE uf_devedor IS NULL OR trim(uf_devedor) ILIKE '{STATE}'",
    "sanction_clean": "SELECT * FROM sancoes_limpas",
    "state_debt_window": """SELECT * REPLACE (CAST(saldo_cda AS DOUBLE) AS saldo_cda,
        CAST(saldo_nucleo AS DOUBLE) AS saldo_nucleo) FROM divida_mg""",
    "union_debts": f"SELECT {_DEBT_COLUMNS} FROM divida_uniao",
    "union_sanctions": "SELECT * FROM sancoes_limpas",
    "load_audit": """SELECT 'divida_ativa_uniao' AS tabela, categoria AS parte,
            count(*) AS linhas FROM divida_uniao GROUP BY categoria
        UNION ALL SELECT 'divida_ativa_mg', 'todas', count(*) FROM divida_mg
        UNION ALL SELECT 'sancoes', cadastro, count(*) FROM sancoes_limpas GROUP BY cadastro""",
    "ingest_account": """SELECT 'divida_ativa_uniao' AS tabela, 'geral' AS parte,
            CAST(sum(if(resto = 1, 2, 1)) AS BIGINT) AS lidas,
            count(*) FILTER (resto IN (1, 3)) AS carregadas,
            count(*) FILTER (resto = 0) AS recusadas
        FROM (SELECT CAST(cnpj_basico AS BIGINT) % 4 AS resto FROM empresas)
        UNION ALL SELECT 'divida_ativa_mg', 'todas', (SELECT count(*) FROM divida_mg_bruta),
            count(*), 0 FROM divida_mg""",
    "duplicate_keys": """SELECT 'socios' AS tabela, cnpj_basico AS chave, count(*) AS linhas
        FROM socios GROUP BY cnpj_basico HAVING count(*) > 1""",
    "parse_money_br": f"""SELECT numero_inscricao, valor_consolidado AS texto,
        CAST({_money("valor_consolidado")} AS DOUBLE) AS valor FROM divida_bruta""",
    "parse_money_wide": """SELECT o_orderkey,
        CAST(12345678901 + o_orderkey AS VARCHAR) || '123456.'
            || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '00' AS divida,
        '9876543210' || CAST(100000 + o_custkey % 9 AS VARCHAR) || '.'
            || lpad(CAST(o_orderkey % 997 AS VARCHAR), 4, '0') || '00' AS saldo
        FROM orders""",
    "parse_decimal_comma": f"""SELECT cnpj_basico,
        {_number("replace(capital_social, ',', '.')", "DOUBLE")} AS capital
        FROM empresas""",
    "format_money_br": f"""SELECT o_orderkey,
        {_br_amount("CAST(o_totalprice AS DECIMAL(18,2)) * 1000")} AS milhares,
        'R$ ' || {_br_amount("CAST(o_totalprice AS DECIMAL(18,2))")} AS reais,
        {_br_rounded("o_totalprice")} AS inteiros FROM orders""",
    "format_thousands": f"SELECT o_orderkey, {_br_whole('o_orderkey * 1001 + o_custkey')} "
    "AS texto FROM orders",
    "format_id": """SELECT numero_inscricao, cpf_cnpj AS cnpj, cnpj_basico,
        regexp_replace(cpf_cnpj, '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5')
            AS cnpj_formatado FROM divida_uniao""",
    "excel_serial_date": f"""SELECT numero_cda, b.data_serial,
        {_iso_of_serial("n")} AS data_inscricao
        FROM (SELECT *, {_number("data_serial", "DOUBLE")} AS n FROM divida_mg_bruta) AS b""",
    "date_br": " UNION ALL ".join(
        f"SELECT '{table}' AS tabela, {key} AS chave, {_br_date(column)} AS data FROM {table}"
        for table, key, column in (
            ("divida_bruta", "numero_inscricao", "data_inscricao"),
            ("estabelecimentos", "cnpj_basico", "data_inicio_atividade"),
            ("socios", "nome_socio_razao_social", "data_entrada_sociedade"),
            ("sancoes_brutas", "fundamentacao", "data_inicio"),
            ("sancoes_brutas", "fundamentacao", "data_fim"),
        )
    ),
    "phone_text": """SELECT cnpj_basico, cnpj_ordem,
        CASE WHEN length(ddd_1) > 0 AND length(telefone_1) > 0
             THEN '(' || ddd_1 || ') ' || telefone_1 END AS telefone,
        CASE WHEN length(correio_eletronico) > 0 THEN correio_eletronico END AS email
        FROM estabelecimentos""",
    "simples_status": "SELECT * FROM situacao_simples",
    "universe": f"SELECT {_UNIVERSE_COLUMNS} FROM base_matrizes",
    "universe_one_state": f"SELECT {_UNIVERSE_COLUMNS} FROM base_matrizes WHERE uf = '{STATE}'",
    "universe_enriched": f"""SELECT {_UNIVERSE_COLUMNS}, municipio, cnae_descricao,
        natureza_descricao, motivo_descricao FROM universo""",
    "debt_by_company": "SELECT * FROM soma_uniao",
    "state_debt_by_company": "SELECT * FROM soma_mg",
    "sanctions_by_company": "SELECT * FROM soma_sancoes",
    "findings": f"SELECT {_FINDING_COLUMNS} FROM apontados",
    "forecast_labels": "SELECT cnpj, cnd_federal_prognostico, cdt_estadual_mg_prognostico "
    "FROM apontados",
    "findings_text": "SELECT cnpj, apontamentos_texto FROM apontados",
    "regime": f"""SELECT cnpj, ({_REGIME})[1] AS regime_provavel,
        ({_REGIME})[2] AS regime_confianca FROM universo""",
    "lead_score": "SELECT cnpj, outro_score AS score, qtd_apontamentos FROM leads_todos",
    "leads": f"SELECT {_LEAD_COLUMNS} FROM leads",
    "leads_one_state": f"SELECT {_LEAD_COLUMNS} FROM leads WHERE uf = '{STATE}'",
    "leads_all": f"SELECT {_LEAD_COLUMNS} FROM leads_todos",
    "leads_with_branches": f"SELECT {_LEAD_COLUMNS} FROM leads_unidades",
    "lead_tags": _tags(),
    "kpi_summary": "SELECT * FROM kpi",
    "kpi_shares": f"""SELECT indicador, valor, CAST(valor AS DOUBLE) / total AS participacao,
        if(total = 0, '{fv.EMPTY_MARK}', ({_TENTHS} // 10) || ',' || ({_TENTHS} % 10)
           || '{fv.SHARE_SUFFIX}') AS texto
        FROM (UNPIVOT (SELECT * FROM kpi_todos) ON {", ".join(_SHARE_NAMES)}
              INTO NAME indicador VALUE valor)""",
    "panorama": _overview("cut", "kpi"),
    "panorama_all": _overview("all", "kpi_todos"),
    "top_municipalities": _TOP,
    "by_regime": "SELECT regime_provavel AS regime, count(*) AS total FROM leads GROUP BY 1",
    "municipality_list": "SELECT DISTINCT municipio FROM leads WHERE municipio IS NOT NULL",
    "relative_to_max": f"""SELECT *, CAST(total AS DOUBLE) / max(total) OVER () * 100
        AS percentual_do_maior FROM ({_TOP})""",
    "lead_search": _search(_FILTERED),
    "lead_search_municipality": _search(f"municipio = '{IN_MUNICIPALITY.municipio}'"),
    "lead_search_text": _search(
        f"razao_social ILIKE '%{BY_TEXT.busca}%' OR nome_fantasia ILIKE '%{BY_TEXT.busca}%' "
        "OR contains(cnpj, '17')"
    ),
    "lead_search_id": _search(
        f"razao_social ILIKE '%{BY_ID.busca}%' OR nome_fantasia ILIKE '%{BY_ID.busca}%' "
        "OR contains(cnpj, '000011')"
    ),
    "lead_order_score": _place(
        "score DESC, dau_valor_total DESC, cnpj", "score, dau_valor_total, cnpj"
    ),
    "lead_order_divida": _place("dau_valor_total DESC, cnpj", "dau_valor_total, cnpj"),
    "lead_order_divida_mg": _place("dam_valor_total DESC, cnpj", "dam_valor_total, cnpj"),
    "lead_order_capital": _place(
        "capital_social DESC NULLS LAST, cnpj", "capital_social, cnpj"
    ),
    "lead_order_razao_social": _place("razao_social NULLS LAST, cnpj", "razao_social, cnpj"),
    "lead_page": f"""{_search(_SECOND_PAGE)} ORDER BY score DESC, dau_valor_total DESC, cnpj
        LIMIT {SECOND_PAGE.por_pagina} OFFSET {SECOND_PAGE.offset}""",
    "lead_page_stored": f"""SELECT {_LEAD_COLUMNS} FROM leads
        ORDER BY score DESC, dau_valor_total DESC, cnpj
        LIMIT {STORED_PAGE.por_pagina} OFFSET {STORED_PAGE.offset}""",
    "lead_page_count": f"""SELECT total,
        greatest(1, (total + {SECOND_PAGE.por_pagina - 1}) // {SECOND_PAGE.por_pagina})
            AS paginas,
        CAST(if(total = 0, 0, {SECOND_PAGE.offset + 1}) AS BIGINT) AS inicio,
        least(total, {SECOND_PAGE.pagina * SECOND_PAGE.por_pagina}) AS fim
        FROM (SELECT count(*) AS total FROM leads WHERE {_SECOND_PAGE})""",
    "dossier": f"""SELECT l.cnpj, l.razao_social,
        {_br_date("l.data_inicio_atividade")} AS inicio_atividade,
        (SELECT count(*) FROM divida_uniao AS d WHERE d.cnpj_basico = l.cnpj_basico)
            AS qtd_inscricoes_divida,
        (SELECT CAST(max(valor_consolidado) AS DOUBLE) FROM divida_uniao AS d
         WHERE d.cnpj_basico = l.cnpj_basico) AS maior_divida,
        (SELECT count(*) FROM divida_mg AS m WHERE m.cnpj_basico = l.cnpj_basico)
            AS qtd_inscricoes_divida_mg,
        (SELECT CAST(max(saldo_cda) AS DOUBLE) FROM divida_mg AS m
         WHERE m.cnpj_basico = l.cnpj_basico) AS maior_divida_mg,
        (SELECT count(*) FROM sancoes_limpas AS s WHERE s.cnpj_basico = l.cnpj_basico)
            AS qtd_sancoes,
        (SELECT count(*) FROM socios AS p WHERE p.cnpj_basico = l.cnpj_basico) AS qtd_socios,
        (SELECT count(*) FROM socios AS p
         WHERE p.cnpj_basico = l.cnpj_basico
           AND p.qualificacao_socio IN (SELECT codigo FROM qualificacoes))
            AS qtd_socios_qualificados
        FROM leads AS l""",
    "dossier_federal": _entries(
        "divida_uniao",
        "categoria, situacao_inscricao, receita_principal, data_inscricao, "
        "indicador_ajuizado, CAST(valor_consolidado AS DOUBLE) AS valor_consolidado, "
        "unidade_responsavel",
        "valor_consolidado DESC NULLS LAST, categoria, situacao_inscricao, receita_principal, "
        "data_inscricao, indicador_ajuizado NULLS LAST, unidade_responsavel",
    ),
    "dossier_state": _entries(
        "divida_mg",
        "numero_cda, data_inscricao, especie, CAST(saldo_cda AS DOUBLE) AS saldo_cda, "
        "CAST(saldo_nucleo AS DOUBLE) AS saldo_nucleo",
        "saldo_cda DESC NULLS LAST, numero_cda, data_inscricao, especie, saldo_nucleo",
    ),
    "dossier_sanctions": _entries(
        "sancoes_limpas",
        "cadastro, tipo_sancao, data_inicio, data_fim, orgao_sancionador, fundamentacao",
        "cadastro, tipo_sancao, data_inicio, orgao_sancionador, fundamentacao",
    ),
    "dossier_partners": """SELECT cnpj_basico, row_number() OVER (
        PARTITION BY cnpj_basico ORDER BY nome, data_entrada_sociedade) AS posicao,
        nome, qualificacao, data_entrada_sociedade, faixa_etaria
    FROM (SELECT s.cnpj_basico, s.nome_socio_razao_social AS nome, q.descricao AS qualificacao,
                 s.data_entrada_sociedade, s.faixa_etaria
          FROM socios AS s LEFT JOIN qualificacoes AS q ON q.codigo = s.qualificacao_socio
          WHERE s.cnpj_basico IN (SELECT cnpj_basico FROM leads))""",
    "dossier_one": """SELECT 'divida' AS lista, cnpj_basico, row_number() OVER (
        PARTITION BY cnpj_basico ORDER BY valor_consolidado DESC NULLS LAST) AS posicao,
        CAST(valor_consolidado AS DOUBLE) AS valor, CAST(NULL AS VARCHAR) AS nome
    FROM divida_uniao WHERE cnpj_basico IN (SELECT cnpj_basico FROM procurados)
    UNION ALL
    SELECT 'socio', cnpj_basico, row_number() OVER (
        PARTITION BY cnpj_basico ORDER BY nome_socio_razao_social, data_entrada_sociedade),
        NULL, nome_socio_razao_social
    FROM socios WHERE cnpj_basico IN (SELECT cnpj_basico FROM procurados)""".replace(
        "(SELECT cnpj_basico FROM procurados)",
        "(SELECT cnpj_basico FROM leads_todos WHERE cnpj IN ("
        + ", ".join(f"'{re.sub('[^0-9]', '', cnpj)}'" for cnpj in LOOKED_UP) + "))",
    ),
    "dossier_not_found": """SELECT cpf_cnpj AS procurado FROM divida_uniao
        WHERE cpf_cnpj NOT IN (SELECT cnpj FROM leads)""",
    "stage_roundtrip": f"SELECT {_LEAD_COLUMNS} FROM leads",
    "append_slices": "SELECT * FROM empresas",
    "export_sheet": f"SELECT {_SHEET} FROM leads_todos WHERE qtd_apontamentos >= 1",
    "export_sheet_files": f"""SELECT {_SHEET_TEXT}, CAST((row_number() OVER (
            ORDER BY score DESC, dau_valor_total DESC, razao_social, cnpj) - 1) // {SHEET_ROWS}
            AS INTEGER) AS arquivo
        FROM leads""",
    "export_sheet_csv": """SELECT cnpj_formatado AS "CNPJ", CAST(score AS VARCHAR) AS "Score",
        apontamentos_texto AS "Apontamentos", municipio AS "Município"
        FROM (SELECT * FROM leads
              ORDER BY score DESC, dau_valor_total DESC, razao_social, cnpj LIMIT 200)""",
}


def _no_findings_sources() -> dict[str, str]:
    """The CTEs as if no debt or sanction were on file."""
    sources = ("divida_uniao", "divida_mg", "sancoes_limpas")
    return CTES | {name: f"SELECT * FROM ({CTES[name]}) WHERE FALSE" for name in sources}


def oracle_sql() -> dict[str, str]:
    """Check SQL per query name."""
    texts = {name: _with_ctes(query, CTES) for name, query in _QUERIES.items()}
    every_lead = f"SELECT {_LEAD_COLUMNS} FROM leads_todos"
    texts["leads_no_findings"] = _with_ctes(every_lead, _no_findings_sources())
    return texts
