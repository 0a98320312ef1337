"""Shapes of the physical plans that must hold whatever the data size."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from garimpo_checks import spark_queries
from garimpo.operators import dossier, search, universe
from garimpo.operators.reports import top_municipalities
from garimpo.sinks.stages import replace_keyed_stage, replace_ordered_stage, replace_stage

SF = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big_tables(spark):
    """Plans as if nothing were small enough to broadcast."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


@pytest.mark.parametrize(
    "name",
    ["leads", "leads_with_branches", "findings", "kpi_summary", "panorama", "lead_page",
     "dossier", "debt_clean", "state_debt_window", "lead_tags", "export_sheet"],
)
def test_no_python_and_no_cross_join(spark, big_tables, name):
    plan = plan_of(spark_queries.QUERIES[name](spark, SF))
    for operator in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
    assert "BroadcastHashJoin" not in plan


def test_company_side_is_joined_before_establishments(spark, big_tables):
    """Facts, companies and Simples meet on unique keys; establishments join once."""
    plan = plan_of(spark_queries.leads(spark, SF))
    joins = re.findall(r"SortMergeJoin \[(cnpj_basico#.*?)\], \[cnpj_basico#.*?\], (\w+)", plan)
    assert [kind for _, kind in joins] == ["Inner", "LeftOuter", "LeftOuter"]
    # Establishments and the company side are shuffled for the last join alone, by two
    # columns; companies, Simples and the facts by the key.
    assert len(re.findall(r"Exchange hashpartitioning\(cnpj_basico#\d+, _segunda", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(cnpj_basico#\d+, \d+\)", plan)) == 3


def test_missing_sources_cost_nothing(spark):
    plan = plan_of(spark_queries.leads_no_findings(spark, SF))
    assert "ExistingRDD" not in plan and "Aggregate" not in plan
    assert not re.search(r"orders|lineitem|events", plan)


def test_facts_combine_before_each_shuffle(spark):
    plan = plan_of(spark_queries.QUERIES["debt_by_company"](spark, SF))
    assert plan.count("partial_count(1)") == 1 and "partial_sum(" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_reports_read_their_columns_only(spark, tmp_path):
    leads = replace_stage(spark_queries.leads(spark, SF), str(tmp_path / "leads"))
    plan = plan_of(top_municipalities(leads))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema == "municipio:string,qtd_apontamentos:int"
    assert "PushedFilters: [IsNotNull(municipio)]" in plan
    assert "TakeOrderedAndProject" in plan


def test_search_is_pushed_to_the_scan(spark, tmp_path):
    leads = replace_stage(spark_queries.leads(spark, SF), str(tmp_path / "leads"))
    spec = search.SearchSpec(
        municipio="NATION_1", regime="real", com_divida=True, score_minimo=10, pagina=3
    )
    plan = plan_of(search.page(leads, spec))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S).group(1)
    for condition in (
        "GreaterThanOrEqual(score,10)",
        "EqualTo(municipio,NATION_1)",
        "StringStartsWith(regime_provavel,Lucro Real)",
        "EqualTo(tem_divida_ativa_uniao,true)",
    ):
        assert condition in pushed
    assert "TakeOrderedAndProject(limit=150" in plan


@pytest.mark.parametrize("source", ["debts", "state_debts", "sanctions", "socios"])
def test_dossier_looks_companies_up(spark, tmp_path, source):
    tables = spark_queries._tables(spark, SF)
    partners = spark_queries._partners(spark, SF)[0]
    rows = partners if source == "socios" else getattr(tables, source)
    stage = replace_keyed_stage(rows, str(tmp_path / source), dossier.KEY)
    assert stage.count() == rows.count() and stage.columns == rows.columns
    own = dossier.of_companies(stage, ["00.000.008/0001-08", "00000004000104"])
    plan = plan_of(dossier._mark_copies(own))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S).group(1)
    assert "In(cnpj_basico, [00000004,00000008])" in pushed


def test_universe_filters_sit_below_the_joins(spark, tmp_path, big_tables):
    tables = {
        name: replace_stage(rows, str(tmp_path / name))
        for name, rows in spark_queries._registry(spark, SF).items()
    }
    params = spark_queries.PARAMS.replace(uf="ASIA")
    plan = plan_of(
        universe.base_rows(
            tables["estabelecimentos"], tables["empresas"], tables["simples"], params
        )
    )
    assert "EqualTo(uf,ASIA)" in plan and "EqualTo(identificador_matriz_filial,1)" in plan
    assert "StringStartsWith(natureza_juridica,2)" in plan
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("logradouro" in schema for schema in read)


def test_state_partitions_are_pruned(spark, tmp_path):
    leads = replace_stage(spark_queries.leads(spark, SF), str(tmp_path / "l"), ["uf"])
    plan = plan_of(leads.where("uf = 'ASIA'"))
    assert re.search(r"PartitionFilters: \[isnotnull\(uf#\d+\), \(uf#\d+ = ASIA\)\]", plan)


def test_ordered_stage_narrows_scores_and_finds_ids(spark, tmp_path):
    rows = spark_queries.leads_all(spark, SF)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        leads = replace_ordered_stage(
            rows, str(tmp_path / "l"), search.ORDERINGS["score"], ["cnpj"]
        )
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = (
        leads.groupBy("_metadata.file_name")
        .agg(F.min("score").alias("low"), F.max("score").alias("high"))
        .orderBy("file_name")
        .collect()
    )
    assert len(files) > 3
    assert all(later.high <= earlier.low for earlier, later in zip(files, files[1:]))
    one = leads.first().cnpj
    assert leads.where(F.col("cnpj") == one).count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark, big_tables):
    from garimpo.sinks.stages import save_keyed_table

    tables = spark_queries._registry(spark, SF)
    save_keyed_table(tables["empresas"], "t_empresas", 4)
    save_keyed_table(tables["simples"], "t_simples", 4)
    try:
        joined = universe.companies_outside_simples(
            spark.table("t_empresas"), spark.table("t_simples"), spark_queries.PARAMS
        )
        assert "Exchange" not in plan_of(joined) and joined.count() > 0
    finally:
        spark.sql("DROP TABLE t_empresas")
        spark.sql("DROP TABLE t_simples")
