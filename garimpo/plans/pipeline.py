"""The whole job: landing zone to stage tables, leads and sheet."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from garimpo import fixed_values as fv
from garimpo.operators import dossier as dossiers
from garimpo.operators import reports
from garimpo.operators.facts import facts_by_company
from garimpo.operators.findings import COLUMNS as FINDING_COLUMNS
from garimpo.operators.findings import add_findings
from garimpo.operators.leads import leads as lead_rows
from garimpo.operators.ordering import PLACE, parts_of_order
from garimpo.operators.search import ORDERINGS, STORED_ORDER, SearchSpec, stored_page
from garimpo.operators.search import page as search_page
from garimpo.operators.universe import COLUMNS as UNIVERSE_COLUMNS
from garimpo.operators.universe import LOOKUPS, base_rows, enrich, universe
from garimpo.parameters import Parameters
from garimpo.plans.load import CARRIED, Load, Shape, Source, load
from garimpo.sinks import versions
from garimpo.sinks.audit import require_unique
from garimpo.sinks.export import ROWS_PER_FILE, default_target, write_sheet
from garimpo.sinks.stages import ordered_writer, read_stage
from garimpo.sources import federal_debt, sanctions, state_debt
from garimpo.sources.header_csv import (
    Aliases,
    by_header,
    plain_names,
    resolve_names,
    to_canonical,
)
from garimpo.sources.periods import latest_period_folder, latest_snapshot_files
from garimpo.sources.records import SourceMissing
from garimpo.sources.registry import (
    list_files,
    slice_paths,
    string_schema,
    suffix_glob,
    suffix_globs,
)

_HEADER_FILES = suffix_globs("csv", "txt")


@dataclass
class Tables:
    """Clean source tables, as read from a stage folder or built by hand."""

    registry: dict[str, DataFrame]
    debts: DataFrame
    state_debts: DataFrame
    sanctions: DataFrame

    @property
    def lookups(self) -> dict[str, DataFrame]:
        return {name: self.registry[name] for name in LOOKUPS}


#: Registry tables that no result reads; a month without them is loaded all the same.
UNREAD = ("paises",)

AUDIT = "cargas"
_AUDIT_SCHEMA = (
    "tabela string, parte string, arquivo string, lidas long, carregadas long, recusadas long"
)


def load_audit(spark: SparkSession, stage: str) -> DataFrame:
    """What was loaded: per table, part and file the lines read, the rows that the run asked
    for and the lines that were rejected."""
    if AUDIT not in versions.current(spark, stage):
        return spark.createDataFrame([], _AUDIT_SCHEMA)
    return read_stage(spark, f"{stage}/{AUDIT}", _AUDIT_SCHEMA)


def _commit(spark: SparkSession, stage: str, loads: Mapping[str, Load]) -> None:
    """Make loaded tables current together, with the account of what was loaded."""
    rows = [(table, *line) for table, load in loads.items() for line in load.audit]
    before = load_audit(spark, stage).where(~F.col("tabela").isin(*loads))
    folder = versions.new_folder(AUDIT)
    account = before.unionAll(spark.createDataFrame(rows, _AUDIT_SCHEMA))
    account.coalesce(1).write.parquet(f"{stage}/{folder}")
    tables = {AUDIT: versions.Version(folder)}
    for load in loads.values():
        tables |= load.versions
    versions.commit(spark, stage, tables)


def _rejects(table: str, loaded: Load) -> dict[str, int]:
    """Rejected lines of a table, in all and by file, if there are any."""
    by_file = {f"{table}_recusadas {file}": n for _, file, _, _, n in loaded.audit if n}
    return {f"{table}_recusadas": loaded.rejected, **by_file} if by_file else {}


def _of_state(columns: Sequence[str], uf: str | None) -> Shape:
    def shape(rows: DataFrame) -> DataFrame:
        if uf is None or "uf" not in columns:
            return rows
        return rows.where((F.col("uf") == uf) | F.col("_recusada"))

    return shape


def ingest_registry(
    spark: SparkSession, landing: str, stage: str, params: Parameters
) -> dict[str, int]:
    """Registry of the newest month to Parquet, one state only where ``uf`` is known.

    All files are looked for before the first table is written, and all tables become
    current together. A load of the whole country is laid out by state, so that a later run
    for one state reads that state only. Lines that do not fit the layout go to
    ``<table>_recusadas`` and are counted like the rows of a table.
    """
    root = latest_period_folder(spark, landing)
    found: dict[str, list[str]] = {}
    for table in fv.REGISTRY_LAYOUTS:
        folder = fv.REGISTRY_FOLDERS[table]
        wanted = (
            slice_paths(root, folder, None if params.fatias is None else range(params.fatias))
            if table in fv.SLICED_TABLES
            else f"{root}/{folder}"
        )
        found[table] = list_files(spark, wanted, suffix_glob(fv.REGISTRY_SUFFIXES[table]))
    missing = [table for table, paths in found.items() if not paths]
    if needed := [table for table in missing if table not in UNREAD]:
        raise SourceMissing(f"no files for {', '.join(needed)} under {root}")

    loads = {}
    for table, columns in fv.REGISTRY_LAYOUTS.items():
        if table in missing:
            continue
        source = Source("todas", found[table], columns, _of_state(columns, params.uf))
        loads[table] = load(
            spark, stage, table, [source],
            partition_by=["uf"] if params.uf is None and "uf" in columns else [],
            key=dossiers.KEY if table == "socios" else None,
        )
    _commit(spark, stage, loads)
    loaded = dict.fromkeys(missing, 0)
    for table, done in loads.items():
        loaded |= {table: done.loaded, f"{table}_recusadas": done.rejected}
    return loaded


def _header_sources(
    spark: SparkSession,
    files: Mapping[str, Sequence[str]],
    aliases: Aliases,
    clean: Callable[[DataFrame, str], DataFrame],
) -> list[Source]:
    """One source per part and header; files without a company id are left out."""
    sources = []
    for part, paths in files.items():
        for names, same in by_header(spark, paths).items():
            if resolve_names(names, aliases)["cpf_cnpj"] is None:
                continue

            def shape(rows: DataFrame, names=names, part=part) -> DataFrame:
                named = rows.toDF(*names, *CARRIED)
                return clean(to_canonical(named, aliases, CARRIED), part)

            sources.append(Source(part, same, plain_names(names), shape, header=True))
    if not sources:
        raise SourceMissing(f"no file with a company id for {', '.join(files) or 'any part'}")
    return sources


def ingest_federal_debt(
    spark: SparkSession, folders: Mapping[str, str], stage: str, params: Parameters
) -> dict[str, int]:
    """Federal debt from ``{category: folder}`` to Parquet, rejected lines beside it.

    A category without files is counted as 0; without any file nothing is replaced.
    """
    files = {name: list_files(spark, path, _HEADER_FILES) for name, path in folders.items()}
    sources = _header_sources(
        spark, files, fv.FEDERAL_DEBT_ALIASES,
        lambda rows, part: federal_debt.clean(rows, part, params.uf, CARRIED),
    )
    table = "divida_ativa_uniao"
    done = load(spark, stage, table, sources, key=dossiers.KEY)
    _commit(spark, stage, {table: done})
    return {table: done.loaded, **_by_part(table, done, files), **_rejects(table, done)}


def _by_part(table: str, done: Load, parts: Iterable[str]) -> dict[str, int]:
    """Rows by category or register, 0 where there was no file."""
    counts = {f"{table} {part}": 0 for part in parts}
    for part, _, _, rows, _ in done.audit:
        counts[f"{table} {part}"] += rows
    return counts


def ingest_sanctions(
    spark: SparkSession, landing: str, stage: str, as_of: dt.date
) -> dict[str, int]:
    """Newest snapshot of each register to Parquet, rejected lines beside it."""
    files = latest_snapshot_files(spark, landing, as_of)
    sources = _header_sources(
        spark, files, fv.SANCTION_ALIASES,
        lambda rows, part: sanctions.clean(rows, part, CARRIED),
    )
    done = load(spark, stage, "sancoes", sources, key=dossiers.KEY)
    _commit(spark, stage, {"sancoes": done})
    counts = _by_part("sancoes", done, fv.SANCTION_REGISTERS)
    return {"sancoes": done.loaded, **counts, **_rejects("sancoes", done)}


def ingest_state_debt(
    spark: SparkSession,
    paths: str | Sequence[str],
    stage: str,
    params: Parameters,
    as_of: dt.date,
) -> dict[str, int]:
    """State debt of the last days to Parquet; lines with less than seven cells beside it."""
    files = [
        path
        for one in ([paths] if isinstance(paths, str) else paths)
        for path in list_files(spark, one, _HEADER_FILES)
    ]
    if not files:
        raise SourceMissing(f"no state-debt files under {paths}")
    source = Source(
        "todas", files, fv.STATE_DEBT_CELLS,
        lambda cells: state_debt.clean(cells, as_of, params.janela_dias, CARRIED),
        header=True, short=False, wide=True,
    )
    table = "divida_ativa_mg"
    done = load(spark, stage, table, [source], key=dossiers.KEY)
    _commit(spark, stage, {table: done})
    return {table: done.loaded, **_rejects(table, done)}


def load_tables(spark: SparkSession, stage: str) -> Tables:
    """Clean tables of a stage folder; findings sources not loaded are empty."""

    def optional(table: str, source: ModuleType) -> DataFrame:
        try:
            return read_stage(spark, f"{stage}/{table}", source.SCHEMA)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return source.empty(spark)
            raise

    return Tables(
        registry={
            name: read_stage(spark, f"{stage}/{name}", string_schema(columns))
            for name, columns in fv.REGISTRY_LAYOUTS.items()
        },
        debts=optional("divida_ativa_uniao", federal_debt),
        state_debts=optional("divida_ativa_mg", state_debt),
        sanctions=optional("sancoes", sanctions),
    )


def build_universe(tables: Tables, params: Parameters) -> DataFrame:
    registry = tables.registry
    return universe(
        registry["estabelecimentos"],
        registry["empresas"],
        registry["simples"],
        tables.lookups,
        params,
    )


def build_rows(tables: Tables, params: Parameters) -> DataFrame:
    """Universe rows with universe and finding columns.

    ``saiu_do_simples`` is the finding, never NULL; the universe's own three-valued
    flag stays in ``saiu_do_simples_registro``.
    """
    registry = tables.registry
    facts = facts_by_company(tables.debts, tables.state_debts, tables.sanctions)
    rows = base_rows(
        registry["estabelecimentos"],
        registry["empresas"],
        registry["simples"],
        params,
        company_facts=facts,
    )
    rows = rows.withColumn("saiu_do_simples_registro", F.col("saiu_do_simples"))
    return add_findings(enrich(rows, tables.lookups))


def build_leads(tables: Tables, params: Parameters) -> DataFrame:
    """``leads`` straight from clean tables, nothing written in between."""
    return lead_rows(build_rows(tables, params), params)


_WIDE = "universo_com_apontamentos"
#: Leads with their place in the stored order, and the rows of its parts.
_ORDERED, _PARTS = "leads_em_ordem", "leads_partes"


def transform(spark: SparkSession, stage: str, params: Parameters) -> dict[str, DataFrame]:
    """Make ``universo``, ``apontamentos`` and ``leads`` current and return them.

    The joins run once, into one wide table; ``universo`` and ``apontamentos`` are columns
    of it, ``leads`` its rows in order. All become current together, at the end. Registry
    and code tables must not repeat a key.
    """
    tables = load_tables(spark, stage)
    require_unique(
        {name: (tables.registry[name], "cnpj_basico") for name in ("empresas", "simples")}
        | {name: (codes, "codigo") for name, codes in tables.lookups.items()}
    )
    folders = {table: versions.new_folder(table) for table in (_WIDE, "leads", _PARTS)}
    build_rows(tables, params).write.parquet(f"{stage}/{folders[_WIDE]}")
    wide = spark.read.parquet(f"{stage}/{folders[_WIDE]}")
    ordered_writer(
        lead_rows(wide, params), ORDERINGS[STORED_ORDER],
        lookups=["cnpj", "cnpj_basico", "municipio"], place=PLACE,
    ).parquet(f"{stage}/{folders['leads']}")
    stored = spark.read.parquet(f"{stage}/{folders['leads']}")
    parts_of_order(stored).coalesce(1).write.parquet(f"{stage}/{folders[_PARTS]}")
    own_flag = {"saiu_do_simples": "saiu_do_simples_registro AS saiu_do_simples"}
    versions.commit(
        spark, stage,
        {
            _WIDE: versions.Version(folders[_WIDE]),
            "universo": versions.Version(
                folders[_WIDE], tuple(own_flag.get(name, name) for name in UNIVERSE_COLUMNS),
                schema=wide.schema.toDDL(),
            ),
            "apontamentos": versions.Version(
                folders[_WIDE], tuple(FINDING_COLUMNS), schema=wide.schema.toDDL()
            ),
            "leads": versions.Version(
                folders["leads"], tuple(name for name in stored.columns if name != PLACE),
                schema=stored.schema.toDDL(),
            ),
            _ORDERED: versions.Version(folders["leads"]),
            _PARTS: versions.Version(folders[_PARTS]),
        },
    )
    return {
        name: read_stage(spark, f"{stage}/{name}") for name in ("universo", "apontamentos", "leads")
    }


def page(spark: SparkSession, stage: str, spec: SearchSpec) -> DataFrame:
    """One page of the leads of a finished stage folder.

    All leads in their stored order are read by place, however deep the page.
    """
    if spec.unfiltered and spec.ordenar == STORED_ORDER:
        ordered, parts = (read_stage(spark, f"{stage}/{name}") for name in (_ORDERED, _PARTS))
        return stored_page(ordered, parts, spec)
    return search_page(read_stage(spark, f"{stage}/leads"), spec)


def summary(spark: SparkSession, stage: str, params: Parameters) -> DataFrame:
    """Overview lines of a finished stage folder."""
    return reports.panorama(
        read_stage(spark, f"{stage}/universo"),
        read_stage(spark, f"{stage}/leads"),
        params.somente_com_apontamento,
    )


def dossier(spark: SparkSession, stage: str, cnpjs: Sequence[str]) -> dossiers.Dossier:
    """Everything on file about the given leads of a finished stage folder."""
    tables = load_tables(spark, stage)
    return dossiers.dossier(
        read_stage(spark, f"{stage}/leads"),
        cnpjs,
        tables.debts,
        tables.state_debts,
        tables.sanctions,
        tables.registry["socios"],
        tables.registry["qualificacoes"],
    )


def export(
    spark: SparkSession,
    stage: str,
    folder: str,
    params: Parameters,
    limit: int | None = None,
    min_findings: int = 0,
    rows_per_file: int = ROWS_PER_FILE,
) -> str:
    """Write the lead sheet of a finished stage folder and return its path."""
    return write_sheet(
        read_stage(spark, f"{stage}/leads"),
        default_target(folder, params.uf),
        limit,
        min_findings,
        rows_per_file=rows_per_file,
    )
