"""Time the headline steps over the test tables; prints one JSON line.

Follows a real run: load and clean the sources into stage tables, transform them into
``leads``, then report on the stored leads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from garimpo_checks import spark_queries as q
from garimpo_checks.roles import role
from garimpo import fixed_values as fv
from garimpo.operators import dossier, reports, search
from garimpo.plans import pipeline
from garimpo.plans.session import build_session, work_folder
from garimpo.sinks.export import write_sheet
from garimpo.sinks.stages import read_stage, replace_stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run_all(rows: DataFrame) -> None:
    """Compute every row and column without keeping any."""
    rows.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        int(CPUS),
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run_all(spark.range(1000).groupBy("id").count())

    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    stage = work_folder(spark, "bench-stage")

    def timed(name: str, step) -> None:
        start = time.monotonic()
        step()
        seconds[name] = round(time.monotonic() - start, 3)

    def load(table: str, make) -> None:
        timed(f"load_{table}", lambda: replace_stage(make(), f"{stage}/{table}"))

    for table in fv.REGISTRY_LAYOUTS:
        if table != "paises":
            load(table, lambda table=table: role(spark, SF_DIR, table))
    replace_stage(role(spark, SF_DIR, "qualificacoes"), f"{stage}/paises")
    load("divida_ativa_uniao", lambda: q._debts(spark, SF_DIR))
    load("divida_ativa_mg", lambda: q._state_debts(spark, SF_DIR))
    load("sancoes", lambda: q._sanctions(spark, SF_DIR))
    folders = {name: paths[0] for name, paths in q._write_federal_files(spark, SF_DIR).items()}
    csv_stage = work_folder(spark, "bench-csv")
    timed("ingest_federal_csv",
          lambda: pipeline.ingest_federal_debt(spark, folders, csv_stage, q.PARAMS))
    timed("transform", lambda: pipeline.transform(spark, stage, q.PARAMS))

    tables = pipeline.load_tables(spark, stage)
    leads = read_stage(spark, f"{stage}/leads")
    universe = read_stage(spark, f"{stage}/universo")
    for table in ("estabelecimentos", "divida_ativa_uniao", "divida_ativa_mg", "leads"):
        rows[table] = read_stage(spark, f"{stage}/{table}").count()

    timed("leads_in_one_query", lambda: run_all(pipeline.build_leads(tables, q.PARAMS)))
    timed("kpi_summary", lambda: run_all(reports.kpi_summary(leads)))
    timed("panorama", lambda: run_all(reports.panorama(universe, leads, True)))
    timed("top_municipalities", lambda: run_all(reports.top_municipalities(leads)))
    timed("by_regime", lambda: run_all(reports.by_regime(leads)))
    timed("municipality_list", lambda: run_all(reports.municipality_list(leads)))
    timed("lead_search", lambda: run_all(search.matching(leads, q.FILTERED)))
    timed("lead_search_text", lambda: run_all(search.matching(leads, q.BY_TEXT)))
    timed("lead_page", lambda: run_all(search.page(leads, q.SECOND_PAGE)))
    deep = search.SearchSpec(pagina=40, por_pagina=50)
    timed("lead_page_deep", lambda: run_all(pipeline.page(spark, stage, deep)))
    timed("lead_page_count", lambda: run_all(search.page_count(leads, q.SECOND_PAGE)))
    timed("export_sheet", lambda: write_sheet(leads, work_folder(spark, "bench-sheet")))
    people = (tables.registry["socios"], tables.registry["qualificacoes"])
    sources = (tables.debts, tables.state_debts, tables.sanctions)
    timed("dossier_overview", lambda: run_all(dossier.overview(leads, *sources, *people)))
    timed("dossier_one", lambda: run_all(
        dossier.dossier(leads, q.LOOKED_UP, *sources, *people).inscricoes_divida
    ))
    timed("dossier_federal", lambda: run_all(dossier.federal_entries(leads, tables.debts)))
    timed("dossier_partners", lambda: run_all(dossier.partner_entries(leads, *people)))

    print(
        json.dumps(
            {
                "metric": "load, transform and report",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").split("sf")[-1],
                "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
