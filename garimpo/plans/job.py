"""Command line of the job, for spark-submit.

    spark-submit run.py --stage S --settings run.json ingest --landing L --as-of 2026-07-29
    spark-submit run.py --stage S transform
    spark-submit run.py --stage S summary
    spark-submit run.py --stage S export --folder out --limit 5000
    spark-submit run.py --stage S dossier 12.345.678/0001-95

The landing zone holds the unpacked files: ``receita/<month>/...``, ``pgfn/<quarter>/
{geral,previdenciaria,fgts}``, ``transparencia/<register>_<date>`` and ``mg``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from garimpo import fixed_values as fv
from garimpo.parameters import Parameters
from garimpo.operators.dossier import Dossier
from garimpo.plans import pipeline
from garimpo.plans.session import build_session
from garimpo.sinks.export import ROWS_PER_FILE

SOURCES = ("receita", "pgfn", "mg_divida", "transparencia")
_CATEGORY_FOLDERS = dict(zip(fv.FEDERAL_DEBT_CATEGORIES, ("geral", "previdenciaria", "fgts")))


def read_settings(spark: SparkSession, path: str | None) -> Parameters:
    """Settings from a JSON or YAML file on any file system; defaults without one."""
    if path is None:
        return Parameters()
    text = spark.read.text(path, wholetext=True).first().value
    if path.endswith(".json"):
        return Parameters.from_mapping(json.loads(text))
    import yaml

    return Parameters.from_mapping(yaml.safe_load(text))


def ingest(
    spark: SparkSession,
    landing: str,
    stage: str,
    params: Parameters,
    as_of: dt.date,
    sources: Sequence[str] = SOURCES,
) -> dict[str, int]:
    """Load the chosen sources and return rows per table."""
    unknown = set(sources) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown source: {', '.join(sorted(unknown))}")
    loaded: dict[str, int] = {}
    if "receita" in sources:
        loaded |= pipeline.ingest_registry(spark, f"{landing}/receita", stage, params)
    if "pgfn" in sources:
        quarter = f"{landing}/pgfn/{params.federal_debt_folder}"
        folders = {name: f"{quarter}/{folder}" for name, folder in _CATEGORY_FOLDERS.items()}
        loaded |= pipeline.ingest_federal_debt(spark, folders, stage, params)
    if "mg_divida" in sources:
        loaded |= pipeline.ingest_state_debt(spark, f"{landing}/mg", stage, params, as_of)
    if "transparencia" in sources:
        folder = f"{landing}/transparencia"
        loaded |= pipeline.ingest_sanctions(spark, folder, stage, as_of)
    return loaded


#: Entries of a list that are printed at a time.
PRINTED = 1_000


def print_dossier(found: Dossier, cnpjs: Sequence[str]) -> None:
    """The leads and the start of their lists as lines of JSON."""
    leads = found.lead.toJSON().collect()
    for line in leads:
        print(f"lead {line}")
    if len(leads) < len(set(cnpjs)):
        print(f"{len(set(cnpjs)) - len(leads)} not found")
    for name, rows in found.lists.items():
        for line in rows.orderBy("cnpj_basico", "posicao").limit(PRINTED).toJSON().collect():
            print(f"{name} {line}")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--stage", required=True, help="folder of the stage tables")
    parser.add_argument("--settings", help="JSON or YAML file")
    steps = parser.add_subparsers(dest="step", required=True)
    load = steps.add_parser("ingest")
    load.add_argument("--landing", required=True)
    load.add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    load.add_argument("--source", action="append", choices=SOURCES)
    steps.add_parser("transform")
    steps.add_parser("summary")
    steps.add_parser("dossier").add_argument("cnpj", nargs="+")
    sheet = steps.add_parser("export")
    sheet.add_argument("--folder", required=True)
    sheet.add_argument("--limit", type=int)
    sheet.add_argument("--min-findings", type=int, default=0)
    sheet.add_argument("--rows-per-file", type=int, default=ROWS_PER_FILE)
    args = parser.parse_args(argv)

    spark = build_session()
    params = read_settings(spark, args.settings)
    if args.step == "ingest":
        loaded = ingest(
            spark, args.landing, args.stage, params, args.as_of, args.source or SOURCES
        )
        for table, count in loaded.items():
            print(f"{table}: {count}")
    elif args.step == "export":
        print(
            pipeline.export(
                spark, args.stage, args.folder, params, args.limit, args.min_findings,
                args.rows_per_file,
            )
        )
    elif args.step == "dossier":
        print_dossier(pipeline.dossier(spark, args.stage, args.cnpj), args.cnpj)
    else:
        if args.step == "transform":
            pipeline.transform(spark, args.stage, params)
        for line in pipeline.summary(spark, args.stage, params).orderBy("ordem").collect():
            print(f"{line.indicador}: {line.texto}")


if __name__ == "__main__":
    main()
