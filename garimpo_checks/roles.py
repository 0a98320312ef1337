"""The test tables in the part of the company sources.

Each role is one portable SQL text, run by Spark for the queries and put in front of
the check SQL as a CTE. Roles give raw source rows: cleaning is left to the code under
test. Every role covers its whole table; ids that are no company ids (natural persons)
are there for the cleaning to drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared, so that planning reads no file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
    "value double, props string",
}


def _basico(k: str) -> str:
    return (
        f"CASE WHEN {k} < 100000000 THEN lpad(CAST({k} AS STRING), 8, '0') "
        f"ELSE CAST({k} AS STRING) END"
    )


def _dv(k: str) -> str:
    return f"lpad(CAST({k} % 97 AS STRING), 2, '0')"


def _cnpj(k: str) -> str:
    return f"({_basico(k)}) || '0001' || {_dv(k)}"


def _punctuated(k: str) -> str:
    b = f"({_basico(k)})"
    return (
        f"substr({b}, 1, 2) || '.' || substr({b}, 3, 3) || '.' || substr({b}, 6) "
        f"|| '/0001-' || {_dv(k)}"
    )


def _money_br(amount: str) -> str:
    cents = f"CAST(CAST({amount} AS DECIMAL(18,2)) * 100 AS BIGINT)"
    units = f"CAST(floor({cents} / 100) AS BIGINT)"
    thousands = f"CAST(floor({cents} / 100000) AS BIGINT)"
    tail = f"lpad(CAST({units} % 1000 AS STRING), 3, '0')"
    return (
        f"CASE WHEN {units} >= 1000 THEN CAST({thousands} AS STRING) || '.' || {tail} "
        f"ELSE CAST({units} AS STRING) END || ',' || lpad(CAST({cents} % 100 AS STRING), 2, '0')"
    )


def _iso(timestamp: str) -> str:
    return f"CAST(CAST({timestamp} AS DATE) AS STRING)"


def _br(timestamp: str) -> str:
    iso = _iso(timestamp)
    return f"substr({iso}, 9, 2) || '/' || substr({iso}, 6, 2) || '/' || substr({iso}, 1, 4)"


def _establishment(k: str, nationkey: str, kind: str, ordem: str, source: str) -> str:
    return f"""
        SELECT {_basico(k)} AS cnpj_basico,
               '{ordem}' AS cnpj_ordem,
               {_dv(k)} AS cnpj_dv,
               '{kind}' AS identificador_matriz_filial,
               CASE WHEN {k} % 6 = 0 THEN ''
                    WHEN {k} % 7 = 0 THEN 'LOJA "' || CAST({k} AS STRING) || '"; PRAÇA'
                    ELSE 'FANTASIA ' || CAST({k} AS STRING) END AS nome_fantasia,
               CASE {k} % 11 WHEN 0 THEN '08' WHEN 1 THEN '04' WHEN 2 THEN '03'
                    ELSE '02' END AS situacao_cadastral,
               '2015' || lpad(CAST({k} % 12 + 1 AS STRING), 2, '0') || '10'
                   AS data_situacao_cadastral,
               CASE {k} % 3 WHEN 0 THEN '00' WHEN 1 THEN '01' ELSE '99' END
                   AS motivo_situacao_cadastral,
               CAST(NULL AS STRING) AS nome_cidade_exterior,
               CAST(NULL AS STRING) AS pais,
               CASE WHEN {k} % 29 = 0 THEN NULL
                    ELSE '2001' || lpad(CAST({k} % 12 + 1 AS STRING), 2, '0') || '05' END
                   AS data_inicio_atividade,
               CASE WHEN {k} % 17 = 0 THEN '6431000' WHEN {k} % 13 = 0 THEN '9999999'
                    ELSE '4712100' END AS cnae_fiscal_principal,
               '4930202,2512300' AS cnae_fiscal_secundaria,
               'RUA' AS tipo_logradouro,
               'DAS ACÁCIAS' AS logradouro,
               CAST({k} % 900 AS STRING) AS numero,
               CAST(NULL AS STRING) AS complemento,
               'BAIRRO ' || CAST({k} % 40 AS STRING) AS bairro,
               lpad(CAST({k} % 100000000 AS STRING), 8, '0') AS cep,
               r_name AS uf,
               CASE WHEN {k} % 23 = 0 THEN '9999' ELSE CAST({nationkey} AS STRING) END
                   AS municipio,
               CASE WHEN {k} % 8 = 0 THEN '' ELSE CAST({k} % 80 + 11 AS STRING) END AS ddd_1,
               CASE WHEN {k} % 9 = 0 THEN NULL
                    ELSE lpad(CAST({k} % 100000000 AS STRING), 8, '3') END AS telefone_1,
               CAST(NULL AS STRING) AS ddd_2,
               CAST(NULL AS STRING) AS telefone_2,
               CAST(NULL AS STRING) AS ddd_fax,
               CAST(NULL AS STRING) AS fax,
               CASE WHEN {k} % 10 = 0 THEN ''
                    ELSE 'contato' || CAST({k} AS STRING) || '@exemplo.com.br' END
                   AS correio_eletronico,
               CAST(NULL AS STRING) AS situacao_especial,
               CAST(NULL AS STRING) AS data_situacao_especial
        FROM {source}
        JOIN {{nation}} ON n_nationkey = {nationkey}
        JOIN {{region}} ON r_regionkey = n_regionkey"""


_DEBTOR = "o_orderstatus = 'F' AND o_totalprice >= 400000"
_STATE_DEBTOR = "l_returnflag = 'R' AND l_quantity > 45"
_SANCTIONED = "event_type = 'error' AND value > 60"

ROLES = {
    "estabelecimentos": _establishment("c_custkey", "c_nationkey", "1", "0001", "{customer}")
    + "\n        UNION ALL"
    + _establishment("s_suppkey", "s_nationkey", "2", "0002", "{supplier}"),
    "empresas": f"""
        SELECT {_basico("c_custkey")} AS cnpj_basico,
               'COMÉRCIO ' || c_name || ' LTDA' AS razao_social,
               CASE c_mktsegment WHEN 'FURNITURE' THEN '3999' WHEN 'MACHINERY' THEN '2054'
                    ELSE '2062' END AS natureza_juridica,
               CASE c_custkey % 2 WHEN 0 THEN '49' ELSE '10' END AS qualificacao_responsavel,
               CASE WHEN c_custkey % 50 = 7 THEN 'N/D'
                    WHEN c_custkey % 50 = 12 THEN '7999,9951'
                    WHEN c_custkey % 50 = 28 THEN '12345678901234567,89'
                    ELSE replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING), '.', ',')
                    END AS capital_social,
               CASE WHEN c_acctbal < 0 THEN '00' WHEN c_acctbal < 2500 THEN '01'
                    WHEN c_acctbal < 5000 THEN '03' ELSE '05' END AS porte_empresa,
               CAST(NULL AS STRING) AS ente_federativo_responsavel
        FROM {{customer}}""",
    "simples": f"""
        SELECT {_basico("c_custkey")} AS cnpj_basico,
               CASE WHEN c_custkey % 4 = 0 THEN 'N' ELSE 'S' END AS opcao_pelo_simples,
               '20150620' AS data_opcao_simples,
               CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '00000000' ELSE '20240131' END
                   AS data_exclusao_simples,
               CASE WHEN c_custkey % 7 = 0 THEN 'S' ELSE 'N' END AS opcao_mei,
               '0' AS data_opcao_mei,
               '0' AS data_exclusao_mei
        FROM {{customer}}
        WHERE c_mktsegment <> 'BUILDING'""",
    "socios": f"""
        SELECT {_basico("o_custkey")} AS cnpj_basico,
               '2' AS identificador_socio,
               'SÓCIO ' || CAST(o_orderkey AS STRING) AS nome_socio_razao_social,
               '***' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || '**'
                   AS cpf_cnpj_socio,
               o_orderstatus AS qualificacao_socio,
               replace({_iso("o_orderdate")}, '-', '') AS data_entrada_sociedade,
               CAST(NULL AS STRING) AS pais,
               CAST(NULL AS STRING) AS representante_legal,
               CAST(NULL AS STRING) AS nome_do_representante,
               CAST(NULL AS STRING) AS qualificacao_representante_legal,
               CAST(o_orderkey % 9 AS STRING) AS faixa_etaria
        FROM {{orders}}""",
    "municipios": """
        SELECT CAST(n_nationkey AS STRING) AS codigo, n_name AS descricao FROM {nation}""",
    "cnaes": """
        SELECT * FROM (VALUES ('6431000', 'Bancos de investimento'),
                              ('4712100', 'Comércio varejista de mercadorias em geral'))
            AS lista(codigo, descricao)""",
    "naturezas": """
        SELECT * FROM (VALUES ('2062', 'Sociedade Empresária Limitada'),
                              ('2054', 'Sociedade Anônima Fechada'))
            AS lista(codigo, descricao)""",
    "motivos": """
        SELECT * FROM (VALUES ('00', 'Sem motivo'),
                              ('01', 'Extinção por encerramento liquidação voluntária'))
            AS lista(codigo, descricao)""",
    "qualificacoes": """
        SELECT * FROM (VALUES ('F', 'Sócio-Administrador'), ('O', 'Sócio'))
            AS lista(codigo, descricao)""",
    "divida_bruta": f"""
        SELECT CASE WHEN NOT ({_DEBTOR})
                    THEN lpad(CAST(o_orderkey % 100000000000 AS STRING), 11, '0')
                    WHEN o_orderkey % 2 = 0 THEN {_cnpj("o_custkey")}
                    ELSE {_punctuated("o_custkey")} END AS cpf_cnpj,
               CASE WHEN {_DEBTOR} THEN 'PJ' ELSE 'PF' END AS tipo_pessoa,
               'PRINCIPAL' AS tipo_devedor,
               'DEVEDOR ' || CAST(o_custkey AS STRING) AS nome_devedor,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'AMERICA' WHEN '2-HIGH' THEN ' america '
                    WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'EUROPE'
                    ELSE 'ASIA' END AS uf_devedor,
               'PRFN ' || CAST(o_orderkey % 6 + 1 AS STRING) || 'A REGIAO' AS unidade_responsavel,
               '80.' || CAST(o_orderkey AS STRING) AS numero_inscricao,
               CASE o_orderkey % 5 WHEN 0 THEN 'Ajuizada' ELSE 'Em cobrança' END
                   AS situacao_inscricao,
               CASE o_orderkey % 3 WHEN 0 THEN 'IRPJ' WHEN 1 THEN 'COFINS' ELSE 'CSLL' END
                   AS receita_principal,
               {_iso("o_orderdate")} AS data_inscricao,
               CASE o_orderkey % 4 WHEN 0 THEN 'Sim' WHEN 1 THEN 'sim' WHEN 2 THEN 'Não' END
                   AS indicador_ajuizado,
               CASE WHEN o_orderkey % 40 = 3 THEN 'n/d' ELSE {_money_br("o_totalprice")} END
                   AS valor_consolidado,
               CASE o_orderkey % 7 WHEN 0 THEN 'Dívida Ativa - FGTS'
                    WHEN 1 THEN 'Dívida Ativa - Previdenciária'
                    ELSE 'Dívida Ativa - Geral' END AS categoria
        FROM {{orders}}""",
    "divida_mg_bruta": f"""
        SELECT CASE WHEN {_STATE_DEBTOR} THEN {_punctuated("o_custkey")}
                    ELSE lpad(CAST(l_orderkey % 10000000000000 AS STRING), 13, '0') END AS cpf_cnpj,
               'DEVEDOR ' || CAST(o_custkey AS STRING) AS nome_devedor,
               '01' || lpad(CAST(l_orderkey * 10 + l_linenumber AS STRING), 11, '0')
                   AS numero_cda,
               CASE WHEN l_orderkey % 60 = 9 THEN 'sem data'
                    ELSE CAST(@serial(l_shipdate) + CAST(l_linenumber AS DOUBLE) / 8 AS STRING) END
                   AS data_serial,
               CASE l_linestatus WHEN 'F' THEN 'ICMS' ELSE 'IPVA' END AS especie,
               CASE WHEN l_orderkey % 80 = 5 THEN '-'
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS saldo_cda,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(1 AS DECIMAL(18,2)) AS STRING)
                   AS saldo_nucleo
        FROM {{lineitem}}
        JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "sancoes_brutas": f"""
        SELECT CASE WHEN {_SANCTIONED} THEN {_cnpj("user_id")}
                    ELSE lpad(CAST(event_id % 100000000000 AS STRING), 11, '0') END AS cpf_cnpj,
               'SANCIONADO ' || CAST(user_id AS STRING) AS nome,
               event_type || '-' || CAST(event_id % 2 AS STRING) AS tipo_sancao,
               {_br("ts")} AS data_inicio,
               CAST(NULL AS STRING) AS data_fim,
               'ÓRGÃO ' || CAST(event_id % 20 AS STRING) AS orgao_sancionador,
               'MG' AS uf,
               'Lei 8.666/93, art. ' || CAST(event_id % 100 AS STRING) AS fundamentacao,
               CASE event_id % 3 WHEN 0 THEN 'CEIS' WHEN 1 THEN 'CNEP' ELSE 'CEPIM' END
                   AS cadastro,
               CAST(ts AS DATE) - CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 20 END
                   AS snapshot_date
        FROM {{events}}""",
    "pedidos_por_mes": f"""
        SELECT o_orderkey, o_custkey, substr({_iso("o_orderdate")}, 1, 7) AS competencia
        FROM {{orders}}""",
}

# Days since 1899-12-30, the one thing the two SQL dialects spell differently.
_SERIAL = {
    "spark": "datediff(CAST({0} AS DATE), DATE '1899-12-30')",
    "duckdb": "date_diff('day', DATE '1899-12-30', CAST({0} AS DATE))",
}


def _in_dialect(sql: str, dialect: str) -> str:
    return sql.replace("@serial(l_shipdate)", _SERIAL[dialect].format("l_shipdate"))


def check_sql(role: str) -> str:
    """Text of a role for the check database, where the tables are views."""
    return _in_dialect(ROLES[role], "duckdb").format(**{name: name for name in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the Parquet tables of ``sf_dir``."""
    sql = ROLES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(_in_dialect(sql, "spark"), **used)
