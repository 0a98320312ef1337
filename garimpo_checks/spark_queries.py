"""One query per operator, over the test tables in the part of the company sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo_checks.roles import role, table
from garimpo import fixed_values as fv
from garimpo.functions import dates, identity, money
from garimpo.operators import dossier as dossiers
from garimpo.operators import facts, findings, ordering, reports, search, universe
from garimpo.operators import leads as lead_ops
from garimpo.operators.ordering import with_position
from garimpo.parameters import Parameters, ScoreWeights
from garimpo.plans import pipeline
from garimpo.plans.session import work_folder
from garimpo.sinks import audit, export, stages
from garimpo.sources import federal_debt, header_csv, periods, registry, sanctions, state_debt

Query = Callable[[SparkSession, str], DataFrame]

# The whole country; capital threshold within the range of the test data.
PARAMS = Parameters(uf=None, capital_lucro_real=8000)
EVERY_LEAD = PARAMS.replace(somente_com_apontamento=False)
WITH_BRANCHES = EVERY_LEAD.replace(somente_matriz=False)
OTHER_WEIGHTS = EVERY_LEAD.replace(
    weights=ScoreWeights(
        divida_ativa_uniao=50,
        divida_ativa_mg=40,
        situacao_irregular=5,
        sancao=33,
        saiu_do_simples=7,
        porte_demais=1,
    )
)
STATE = "AMERICA"

# Ids to look up: plain, punctuated, and one of no company.
LOOKED_UP = (
    "00000004000104", "00.000.008/0001-08", "00000016000116", "00000040000140",
    "00.000.044/0001-44", "00000100000103", "99999999000199",
)

# One search with every kind of filter, and texts with and without digits.
FILTERED = search.SearchSpec(
    regime="presumido", com_divida=True, com_sancao=False, score_minimo=30, ordenar="divida"
)
IN_MUNICIPALITY = search.SearchSpec(municipio="NATION_7", ordenar="capital")
BY_TEXT = search.SearchSpec(busca="fantasia 1_7")
BY_ID = search.SearchSpec(busca="0/0001-1")
SECOND_PAGE = search.SearchSpec(pagina=2, por_pagina=20, irregular=False)
STORED_PAGE = search.SearchSpec(pagina=9, por_pagina=30)
#: Rows of a file of the written sheet.
SHEET_ROWS = 250

# Published header names, written over the canonical ones for the round trips.
FEDERAL_HEADERS = {
    "Dívida Ativa - Geral": (
        "CPF_CNPJ", "TIPO_PESSOA", "TIPO_DEVEDOR", "NOME_DEVEDOR", "UF_UNIDADE_RESPONSAVEL",
        "UNIDADE_RESPONSAVEL", "NUMERO_INSCRICAO", "SITUACAO_INSCRICAO", "RECEITA_PRINCIPAL",
        "DATA_INSCRICAO", "INDICADOR_AJUIZADO", "VALOR_CONSOLIDADO",
    ),
    "Dívida Ativa - Previdenciária": (
        "CNPJ/CPF", "Tipo de Pessoa", "Tipo de Devedor", "Nome do Devedor", "UF Devedor",
        "Unidade de Responsável", "Número da Inscrição", "Situação da Inscrição",
        "Tipo de Receita", "Data da Inscrição", "Ajuizado", "Valor Total",
    ),
    "Dívida Ativa - FGTS": (
        "NI Devedor", "tipo pessoa", "tipo devedor", "nome", "uf", "unidade responsável",
        "número inscrição", "situação inscrição", "receita", "data inscrição",
        "indicador ajuizado", "valor",
    ),
}
SANCTION_HEADERS = (
    "CPF OU CNPJ DO SANCIONADO", "NOME INFORMADO PELO ÓRGÃO SANCIONADOR", "TIPO DE SANÇÃO",
    "DATA INÍCIO SANÇÃO", "DATA FINAL SANÇÃO", "ÓRGÃO SANCIONADOR", "UF DO SANCIONADO",
    "FUNDAMENTAÇÃO LEGAL",
)


# --- clean tables ----------------------------------------------------------


def _last_ship_date(spark: SparkSession, sf_dir: str) -> Column:
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.agg(F.max(F.col("l_shipdate").cast("date"))).scalar()


def _debts(spark: SparkSession, sf_dir: str, uf: str | None = None) -> DataFrame:
    return federal_debt.clean(role(spark, sf_dir, "divida_bruta"), F.col("categoria"), uf)


def _state_debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = role(spark, sf_dir, "divida_mg_bruta")
    return state_debt.clean(cells, _last_ship_date(spark, sf_dir), PARAMS.janela_dias)


def _sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanctions.clean(role(spark, sf_dir, "sancoes_brutas"), F.col("cadastro"))


def _registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ("estabelecimentos", "empresas", "simples", *universe.LOOKUPS)
    return {name: role(spark, sf_dir, name) for name in names}


def _tables(spark: SparkSession, sf_dir: str) -> pipeline.Tables:
    return pipeline.Tables(
        registry=_registry(spark, sf_dir),
        debts=_debts(spark, sf_dir),
        state_debts=_state_debts(spark, sf_dir),
        sanctions=_sanctions(spark, sf_dir),
    )


def _universe(spark: SparkSession, sf_dir: str, params: Parameters = PARAMS) -> DataFrame:
    return pipeline.build_universe(_tables(spark, sf_dir), params)


def _rows(spark: SparkSession, sf_dir: str, params: Parameters = PARAMS) -> DataFrame:
    return pipeline.build_rows(_tables(spark, sf_dir), params)


def leads(spark: SparkSession, sf_dir: str, params: Parameters = PARAMS) -> DataFrame:
    return pipeline.build_leads(_tables(spark, sf_dir), params)


def _money_as_double(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({name: F.col(name).cast("double") for name in columns})


# --- sources ---------------------------------------------------------------


def _write_csv(rows: DataFrame, path: str, header: bool = False) -> None:
    rows.write.options(
        header=str(header).lower(),
        sep=fv.CSV_DELIMITER,
        quote=fv.CSV_QUOTE,
        escape=fv.CSV_QUOTE,
        encoding=fv.CSV_ENCODING,
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)


def scan_positional_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "empresas")
    _write_csv(role(spark, sf_dir, "empresas"), path)
    return registry.read_positional_csv(spark, fv.EMPRESAS, path)


def scan_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of ten slices exist, next to files of another kind."""
    rows = role(spark, sf_dir, "estabelecimentos")
    root = work_folder(spark, "landing")
    for number in range(3):
        slice_rows = rows.where(F.pmod(F.crc32("cnpj_basico"), F.lit(3)) == number)
        _write_csv(slice_rows, f"{root}/Estabelecimentos{number}")
    other = role(spark, sf_dir, "simples")
    other.write.mode("append").options(sep=";", extension="TXT").csv(f"{root}/Estabelecimentos0")
    return registry.read_table(spark, root, "estabelecimentos", slices=10, suffix=".CSV")


def scan_filter_uf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "estabelecimentos")
    _write_csv(role(spark, sf_dir, "estabelecimentos"), path)
    return registry.read_positional_csv(spark, fv.ESTABELECIMENTOS, path, uf=STATE)


def scan_header_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "socios")
    _write_csv(role(spark, sf_dir, "socios"), path, header=True)
    return header_csv.read_header_csv(spark, path)


def _write_lines(rows: DataFrame, line: Column, header: str, path: str) -> None:
    """Header files of raw lines, one for each last digit of the company."""
    lines = rows.select(F.right("cnpj_basico", F.lit(1)).alias("final"), line.alias("value"))
    first = lines.select("final", F.lit(header).alias("value")).distinct()
    every = first.withColumn("ordem", F.lit(0)).unionByName(lines.withColumn("ordem", F.lit(1)))
    dealt = every.repartition("final").sortWithinPartitions("final", "ordem").drop("ordem")
    dealt.write.partitionBy("final").text(path)


def _lines_of_companies(spark: SparkSession, sf_dir: str, line: str) -> str:
    path = work_folder(spark, "linhas")
    _write_lines(role(spark, sf_dir, "empresas"), F.expr(line), "CPF_CNPJ;NOME;VALOR", path)
    return path


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debts of a header file, some with a bare delimiter in the name."""
    line = "concat(cnpj_basico, if(cnpj_basico % 7 = 0, ';A;B;1,00', ';A B;1,00'))"
    path = _lines_of_companies(spark, sf_dir, line)
    files = registry.list_files(spark, path, "*.txt")
    found = header_csv.rejected_canonical(spark, files, fv.FEDERAL_DEBT_ALIASES)
    return found.select("largura", "linha")


def scan_quoted_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, some with a line break inside quotes: one record each."""
    line = """concat(cnpj_basico, if(cnpj_basico % 7 = 0, ';"A\\nB";1,00', ';A B;1,00'))"""
    path = _lines_of_companies(spark, sf_dir, line)
    files = registry.list_files(spark, path, "*.txt")
    loaded = header_csv.read_header_csv(spark, files)
    rejected = header_csv.rejected_canonical(spark, files, fv.FEDERAL_DEBT_ALIASES)
    lines = loaded.select(F.lit("carregada").alias("destino"), F.concat_ws(";", *loaded.columns).alias("linha"))
    return lines.unionAll(rejected.select(F.lit("recusada"), "linha"))


def layout_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header file whose later lines have drifted is refused, with its widths."""
    line = "concat(cnpj_basico, if(cnpj_basico % 7 < 2, ';A B;1,00', ';A;B;1,00'))"
    path = _lines_of_companies(spark, sf_dir, line)
    refused = []
    for name in registry.list_files(spark, path, "*.txt"):
        try:
            header_csv.rejected_canonical(spark, [name], fv.FEDERAL_DEBT_ALIASES)
        except registry.LayoutMismatch as error:
            refused.append((str(error).split(": ", 1)[1],))
    return spark.createDataFrame(refused, "motivo string").groupBy("motivo").count()


def _write_federal_files(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    rows = role(spark, sf_dir, "divida_bruta")
    canonical = list(fv.FEDERAL_DEBT_ALIASES)
    files = {}
    for number, (categoria, headers) in enumerate(FEDERAL_HEADERS.items()):
        path = work_folder(spark, f"divida-{number}")
        named = rows.where(F.col("categoria") == categoria).select(
            *[F.col(name).alias(header) for name, header in zip(canonical, headers)]
        )
        _write_csv(named, path, header=True)
        files[categoria] = [path]
    return files


def header_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files with three spellings of the header, accents included."""
    files = _write_federal_files(spark, sf_dir)
    read = federal_debt.read(spark, files, uf=None)
    return _money_as_double(read, "valor_consolidado")


def sanction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "sancoes_brutas")
    canonical = list(fv.SANCTION_ALIASES)
    files = {}
    for register in fv.SANCTION_REGISTERS:
        path = work_folder(spark, register.lower())
        named = rows.where(F.col("cadastro") == register).select(
            *[F.col(name).alias(header) for name, header in zip(canonical, SANCTION_HEADERS)]
        )
        _write_csv(named, path, header=True)
        files[register] = [path]
    return sanctions.read(spark, files)


def state_debt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "divida-mg")
    _write_csv(role(spark, sf_dir, "divida_mg_bruta"), path, header=True)
    return state_debt.read_cells(spark, path)


def layout_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "estabelecimentos")
    _write_csv(role(spark, sf_dir, "estabelecimentos"), path)
    registry.check_layout(spark, fv.ESTABELECIMENTOS, registry.list_files(spark, path, "*.csv"))
    profile = registry.layout_profile(spark, path, "*.csv")
    return profile.groupBy("largura").agg(F.sum("linhas").alias("linhas"))


def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.latest_period(role(spark, sf_dir, "pedidos_por_mes"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    today = events.agg(F.max(F.col("ts").cast("date"))).scalar()
    rows = role(spark, sf_dir, "sancoes_brutas")
    return periods.latest_snapshot(rows, today).withColumn(
        "snapshot_date", F.col("snapshot_date").cast("string")
    )


def debt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_as_double(_debts(spark, sf_dir, uf=STATE), "valor_consolidado")


def sanction_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sanctions(spark, sf_dir)


def state_debt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_as_double(_state_debts(spark, sf_dir), "saldo_cda", "saldo_nucleo")


def union_debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "divida_bruta")
    parts = [
        federal_debt.clean(rows.where(F.col("categoria") == name), name, None)
        for name in fv.FEDERAL_DEBT_CATEGORIES
    ]
    return _money_as_double(federal_debt.union_categories(parts), "valor_consolidado")


def union_sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "sancoes_brutas")
    return sanctions.union_registers(
        [sanctions.clean(rows.where(F.col("cadastro") == r), r) for r in fv.SANCTION_REGISTERS]
    )


# --- functions -------------------------------------------------------------


def parse_money_br(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "divida_bruta").select(
        "numero_inscricao",
        F.col("valor_consolidado").alias("texto"),
        money.parse_money_br(F.col("valor_consolidado")).cast("double").alias("valor"),
    )


def parse_money_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debts and state balances of seventeen digits and four decimals, exact."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("""concat(CAST(12345678901 + o_orderkey AS STRING), '.123.456,',
            lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))""").alias("br"),
        F.expr("""concat('9876543210', CAST(100000 + o_custkey % 9 AS STRING), '.',
            lpad(CAST(o_orderkey % 997 AS STRING), 4, '0'))""").alias("plain"),
    )
    return orders.select(
        "o_orderkey",
        money.parse_money_br(F.col("br")).cast("string").alias("divida"),
        money.parse_plain(F.col("plain")).cast("string").alias("saldo"),
    )


def parse_decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "empresas").select(
        "cnpj_basico",
        money.parse_decimal_comma(F.col("capital_social")).alias("capital"),
    )


def format_money_br(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast(money.MONEY)
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        money.format_money_br(price * 1000).alias("milhares"),
        money.format_reais(price).alias("reais"),
        money.format_reais_rounded(price).alias("inteiros"),
    )


def format_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey") * 1001 + F.col("o_custkey")
    return orders.select("o_orderkey", money.format_thousands(number).alias("texto"))


def format_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    cnpj = identity.digits(F.col("cpf_cnpj"))
    return (
        role(spark, sf_dir, "divida_bruta")
        .where(identity.is_company_id(cnpj))
        .select(
            "numero_inscricao",
            cnpj.alias("cnpj"),
            identity.company_key(cnpj).alias("cnpj_basico"),
            identity.format_cnpj(cnpj).alias("cnpj_formatado"),
        )
    )


def excel_serial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = money.parse_float(F.col("data_serial"))
    return role(spark, sf_dir, "divida_mg_bruta").select(
        "numero_cda", "data_serial", dates.serial_to_iso(serial).alias("data_inscricao")
    )


def date_br(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO, compact, already Brazilian and missing dates."""

    def shown(name: str, key: str, column: str) -> DataFrame:
        value = F.col(column)
        return role(spark, sf_dir, name).select(
            F.lit(name).alias("tabela"),
            F.col(key).alias("chave"),
            dates.date_br(value).alias("data"),
        )

    return reduce(
        DataFrame.unionAll,
        [
            shown("divida_bruta", "numero_inscricao", "data_inscricao"),
            shown("estabelecimentos", "cnpj_basico", "data_inicio_atividade"),
            shown("socios", "nome_socio_razao_social", "data_entrada_sociedade"),
            shown("sancoes_brutas", "fundamentacao", "data_inicio"),
            shown("sancoes_brutas", "fundamentacao", "data_fim"),
        ],
    )


def phone_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "estabelecimentos").select(
        "cnpj_basico",
        "cnpj_ordem",
        identity.phone(F.col("ddd_1"), F.col("telefone_1")).alias("telefone"),
        identity.blank_to_null(F.col("correio_eletronico")).alias("email"),
    )


# --- universe, findings, leads ---------------------------------------------


def simples_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.simples_status(role(spark, sf_dir, "simples"))


def universe_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _registry(spark, sf_dir)
    return universe.base_rows(
        tables["estabelecimentos"], tables["empresas"], tables["simples"], PARAMS
    )


def universe_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir)


def debt_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.debt_by_company(_debts(spark, sf_dir))


def state_debt_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.state_debt_by_company(_state_debts(spark, sf_dir))


def sanctions_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.sanctions_by_company(_sanctions(spark, sf_dir))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    all_facts = facts.facts_by_company(tables.debts, tables.state_debts, tables.sanctions)
    return findings.findings(pipeline.build_universe(tables, PARAMS), all_facts)


def forecast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select(
        "cnpj", "cnd_federal_prognostico", "cdt_estadual_mg_prognostico"
    )


def findings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("cnpj", "apontamentos_texto")


def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).select(
        "cnpj",
        lead_ops.probable_regime(PARAMS.capital_lucro_real).alias("regime_provavel"),
        lead_ops.regime_confidence().alias("regime_confianca"),
    )


def lead_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir, OTHER_WEIGHTS).select("cnpj", "score", "qtd_apontamentos")


def universe_one_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of other states are cut off by the key bitmap before the joins."""
    rows = _universe(spark, sf_dir, PARAMS.replace(uf=STATE))
    return rows.select(*universe.BASE_COLUMNS)


def leads_one_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir, PARAMS.replace(uf=STATE))


def leads_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir, EVERY_LEAD)


def leads_with_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir, WITH_BRANCHES)


def leads_no_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No debt and sanction source was loaded."""
    tables = pipeline.Tables(
        registry=_registry(spark, sf_dir),
        debts=federal_debt.empty(spark),
        state_debts=state_debt.empty(spark),
        sanctions=sanctions.empty(spark),
    )
    return pipeline.build_leads(tables, EVERY_LEAD)


def lead_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = leads_all(spark, sf_dir).withColumn("tags", lead_ops.lead_tags())
    return tagged.select(
        "cnpj",
        F.size("tags").cast("long").alias("qtd"),
        F.array_join("tags.gravidade", ",").alias("gravidades"),
        F.array_join("tags.texto", " / ").alias("textos"),
    )


# --- reports and search ----------------------------------------------------


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpi_summary(leads(spark, sf_dir))


def kpi_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpi_shares(leads_all(spark, sf_dir))


def panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.panorama(universe_base(spark, sf_dir), leads(spark, sf_dir), True)


def panorama_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.panorama(universe_base(spark, sf_dir), leads_all(spark, sf_dir), False)


def top_municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_municipalities(leads_all(spark, sf_dir))


def by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_regime(leads(spark, sf_dir))


def municipality_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.municipality_list(leads(spark, sf_dir))


def relative_to_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.relative_to_max(top_municipalities(spark, sf_dir))


def _search(spec: search.SearchSpec) -> Query:
    return lambda spark, sf_dir: search.matching(leads(spark, sf_dir), spec)


def lead_page_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of leads stored in order, read by place."""
    path = work_folder(spark, "leads-em-ordem")
    keys = search.ORDERINGS[search.STORED_ORDER]
    stages.ordered_writer(leads(spark, sf_dir), keys, ["cnpj"], ordering.PLACE).parquet(path)
    stored = spark.read.parquet(path)
    parts = ordering.parts_of_order(stored)
    return search.stored_page(stored, parts, STORED_PAGE)


def _page(spec: search.SearchSpec) -> Query:
    return lambda spark, sf_dir: search.page(leads(spark, sf_dir), spec)


def _page_count(spec: search.SearchSpec) -> Query:
    return lambda spark, sf_dir: search.page_count(leads(spark, sf_dir), spec)


def _order(name: str) -> Query:
    """All leads with their exact place in the order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = search.ORDERINGS[name]
        rows = leads(spark, sf_dir).select(*dict.fromkeys(column for column, _ in keys))
        return with_position(rows, keys)

    return query


# --- dossier ---------------------------------------------------------------


def _partners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return role(spark, sf_dir, "socios"), role(spark, sf_dir, "qualificacoes")


def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    return dossiers.overview(
        pipeline.build_leads(tables, PARAMS),
        tables.debts,
        tables.state_debts,
        tables.sanctions,
        *_partners(spark, sf_dir),
    )


def dossier_federal(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dossiers.federal_entries(leads(spark, sf_dir), _debts(spark, sf_dir))
    return _money_as_double(entries, "valor_consolidado")


def dossier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dossiers.state_entries(leads(spark, sf_dir), _state_debts(spark, sf_dir))
    return _money_as_double(entries, "saldo_cda", "saldo_nucleo")


def dossier_sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossiers.sanction_entries(leads(spark, sf_dir), _sanctions(spark, sf_dir))


def dossier_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossiers.partner_entries(leads(spark, sf_dir), *_partners(spark, sf_dir))


def dossier_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Federal debts and partners of a few given ids."""
    tables = _tables(spark, sf_dir)
    found = dossiers.dossier(
        pipeline.build_leads(tables, EVERY_LEAD), LOOKED_UP, tables.debts, tables.state_debts,
        tables.sanctions, *_partners(spark, sf_dir),
    )
    debts = found.inscricoes_divida.select(
        F.lit("divida").alias("lista"), "cnpj_basico", "posicao",
        F.col("valor_consolidado").cast("double").alias("valor"), F.lit(None).alias("nome"),
    )
    partners = found.socios.select(
        F.lit("socio").alias("lista"), "cnpj_basico", "posicao", F.lit(None).alias("valor"), "nome"
    )
    return debts.unionByName(partners)


def dossier_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debtors that are no lead."""
    return dossiers.not_found(
        leads(spark, sf_dir), _debts(spark, sf_dir).select("cpf_cnpj"), "cpf_cnpj"
    )


# --- sinks -----------------------------------------------------------------


def stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "leads")
    stored = stages.replace_stage(leads(spark, sf_dir), path, partition_by=["uf"])
    return stored.select(*lead_ops.COLUMNS)


def append_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = role(spark, sf_dir, "empresas")
    path = work_folder(spark, "empresas")
    late = F.pmod(F.crc32("cnpj_basico"), F.lit(2)) == 1
    stages.replace_stage(rows, path)
    stages.replace_stage(rows.where(~late), path)
    return stages.append_stage(rows.where(late), path)


def export_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.lead_sheet(leads_all(spark, sf_dir), min_findings=1)


def export_sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole written sheet read back, every column as text, with the file of each row."""
    path = work_folder(spark, "sheet-files")
    export.write_sheet(leads(spark, sf_dir), path, rows_per_file=SHEET_ROWS)
    sheet = spark.read.options(header="true", sep=";", escape='"').csv(path)
    number = F.regexp_extract(F.input_file_name(), r"part-([0-9]+)-", 1).cast("int")
    return sheet.select("*", number.alias("arquivo"))


def export_sheet_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written sheet read back: values as text."""
    path = work_folder(spark, "sheet")
    export.write_sheet(leads(spark, sf_dir), path, limit=200)
    sheet = spark.read.options(header="true", sep=";", escape='"').csv(path)
    return sheet.select("CNPJ", "Score", "Apontamentos", "Município")


def ingest_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read, loaded and rejected of four sources, as their loads account for them.

    Among the debts are bare delimiters, line breaks inside quotes and natural persons.
    """
    stage, landing = work_folder(spark, "conta"), work_folder(spark, "conta-arquivos")
    line = """concat(cnpj_basico, CASE cnpj_basico % 4 WHEN 0 THEN '000100;A;B;1,00'
        WHEN 1 THEN '000100;"A\nB";1,00' WHEN 2 THEN '100;A B;1,00' ELSE '000100;A B;1,00' END)"""
    companies = role(spark, sf_dir, "empresas")
    _write_lines(companies, F.expr(line), "CPF_CNPJ;NOME;VALOR", f"{landing}/geral")
    folders = {"geral": f"{landing}/geral", "fgts": f"{landing}/fgts"}
    pipeline.ingest_federal_debt(spark, folders, stage, PARAMS)
    cells = role(spark, sf_dir, "divida_mg_bruta").select(*fv.STATE_DEBT_CELLS)
    _write_csv(cells, f"{landing}/mg", header=True)
    pipeline.ingest_state_debt(
        spark, f"{landing}/mg", stage, PARAMS,
        table(spark, sf_dir, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0],
    )
    account = pipeline.load_audit(spark, stage)
    return account.groupBy("tabela", "parte").agg(
        *[F.sum(name).alias(name) for name in ("lidas", "carregadas", "recusadas")]
    )


def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.load_audit(
        {
            "divida_ativa_uniao": (_debts(spark, sf_dir), "categoria"),
            "divida_ativa_mg": (_state_debts(spark, sf_dir), F.lit("todas")),
            "sancoes": (_sanctions(spark, sf_dir), "cadastro"),
        }
    )


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners are listed per company, so their key repeats."""
    names = ("empresas", "simples", "socios")
    return audit.duplicate_keys(
        {name: (role(spark, sf_dir, name), "cnpj_basico") for name in names}
    )


QUERIES: dict[str, Query] = {
    "scan_positional_csv": scan_positional_csv,
    "scan_slices": scan_slices,
    "scan_filter_uf": scan_filter_uf,
    "scan_header_csv": scan_header_csv,
    "rejected_lines": rejected_lines,
    "scan_quoted_break": scan_quoted_break,
    "layout_mismatch": layout_mismatch,
    "header_aliases": header_aliases,
    "sanction_files": sanction_files,
    "state_debt_cells": state_debt_cells,
    "layout_profile": layout_profile,
    "latest_period": latest_period,
    "latest_snapshot": latest_snapshot,
    "debt_clean": debt_clean,
    "sanction_clean": sanction_clean,
    "state_debt_window": state_debt_window,
    "union_debts": union_debts,
    "union_sanctions": union_sanctions,
    "load_audit": load_audit,
    "ingest_account": ingest_account,
    "duplicate_keys": duplicate_keys,
    "parse_money_br": parse_money_br,
    "parse_money_wide": parse_money_wide,
    "parse_decimal_comma": parse_decimal_comma,
    "format_money_br": format_money_br,
    "format_thousands": format_thousands,
    "format_id": format_id,
    "excel_serial_date": excel_serial_date,
    "date_br": date_br,
    "phone_text": phone_text,
    "simples_status": simples_status,
    "universe": universe_base,
    "universe_enriched": universe_enriched,
    "universe_one_state": universe_one_state,
    "debt_by_company": debt_by_company,
    "state_debt_by_company": state_debt_by_company,
    "sanctions_by_company": sanctions_by_company,
    "findings": _findings,
    "forecast_labels": forecast_labels,
    "findings_text": findings_text,
    "regime": regime,
    "lead_score": lead_score,
    "leads": leads,
    "leads_all": leads_all,
    "leads_one_state": leads_one_state,
    "leads_with_branches": leads_with_branches,
    "leads_no_findings": leads_no_findings,
    "lead_tags": lead_tags,
    "kpi_summary": kpi_summary,
    "kpi_shares": kpi_shares,
    "panorama": panorama,
    "panorama_all": panorama_all,
    "top_municipalities": top_municipalities,
    "by_regime": by_regime,
    "municipality_list": municipality_list,
    "relative_to_max": relative_to_max,
    "lead_search": _search(FILTERED),
    "lead_search_municipality": _search(IN_MUNICIPALITY),
    "lead_search_text": _search(BY_TEXT),
    "lead_search_id": _search(BY_ID),
    **{f"lead_order_{name}": _order(name) for name in search.ORDERINGS},
    "lead_page": _page(SECOND_PAGE),
    "lead_page_count": _page_count(SECOND_PAGE),
    "lead_page_stored": lead_page_stored,
    "dossier": dossier,
    "dossier_federal": dossier_federal,
    "dossier_state": dossier_state,
    "dossier_sanctions": dossier_sanctions,
    "dossier_partners": dossier_partners,
    "dossier_one": dossier_one,
    "dossier_not_found": dossier_not_found,
    "stage_roundtrip": stage_roundtrip,
    "append_slices": append_slices,
    "export_sheet": export_sheet,
    "export_sheet_csv": export_sheet_csv,
    "export_sheet_files": export_sheet_files,
}
