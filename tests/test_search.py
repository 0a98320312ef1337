from __future__ import annotations

import dataclasses
import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from garimpo_checks import spark_queries
from garimpo.operators import dossier, reports, search
from garimpo.sinks import export
from garimpo.sinks.stages import replace_stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def leads(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("leads") / "leads")
    return replace_stage(spark_queries.leads_all(spark, SF), path)


def ids(frame):
    return [r.cnpj for r in frame.collect()]


@pytest.mark.parametrize("order", list(search.ORDERINGS))
def test_pages_are_disjoint_and_complete(leads, order):
    spec = search.SearchSpec(ordenar=order, por_pagina=20)
    counts = search.page_count(leads, spec).first()
    pages = [
        ids(search.page(leads, dataclasses.replace(spec, pagina=n)))
        for n in range(1, counts.paginas + 1)
    ]
    seen = [cnpj for page in pages for cnpj in page]
    assert len(seen) == len(set(seen)) == counts.total == leads.count()
    assert all(len(page) == 20 for page in pages[:-1])
    assert search.page(leads, dataclasses.replace(spec, pagina=99)).count() == 0


def test_page_bounds(leads):
    total = leads.count()
    last = total // 20 + 1
    row = search.page_count(leads, search.SearchSpec(por_pagina=20, pagina=last)).first()
    assert (row.total, row.paginas, row.inicio, row.fim) == (total, last, last * 20 - 19, total)
    none = search.page_count(leads, search.SearchSpec(busca="no such thing")).first()
    assert (none.total, none.paginas, none.inicio, none.fim) == (0, 1, 0, 0)


def test_kpis_equal_filtered_counts(leads):
    kpis = reports.kpi_summary(leads).first()
    for field, kpi in {
        "com_divida": kpis.com_divida,
        "com_divida_mg": kpis.com_divida_mg,
        "irregular": kpis.irregulares,
        "com_sancao": kpis.sancionadas,
        "ex_simples": kpis.ex_simples,
    }.items():
        yes = search.matching(leads, search.SearchSpec(**{field: True})).count()
        no = search.matching(leads, search.SearchSpec(**{field: False})).count()
        assert (yes, yes + no) == (kpi, kpis.total)
    real = search.matching(leads, search.SearchSpec(regime="real")).count()
    assert real == kpis.lucro_real
    # A regime that is neither filters nothing.
    assert search.matching(leads, search.SearchSpec(regime="other")).count() == kpis.total
    assert sum(r.total for r in reports.by_regime(leads).collect()) == kpis.total


def test_scores_in_range(leads):
    assert leads.where("score < 0 OR score > 100").count() == 0
    assert leads.where("qtd_apontamentos < 0 OR qtd_apontamentos > 5").count() == 0


def test_text_search(leads):
    def found(text):
        return search.matching(leads, search.SearchSpec(busca=text)).count()

    one = leads.first()
    assert found("zzzz nothing zzzz") == 0
    assert found(one.cnpj_formatado) == 1
    assert found(one.razao_social.lower()) == 1
    assert found("comércio") == leads.count()
    # Wildcards work, a backslash is only a backslash.
    assert found("CUSTOMER%LTDA") == leads.count()
    assert found("\\") == 0 and found("\x01") == 0
    assert found("") == leads.count()


NAMES = ["Ação 1%", "AÇÃO_2", "back\\slash", "a.b*c", "line\nbreak", "x\x01y", "", None]


def _like(value: str | None, text: str) -> bool:
    """Case-insensitive containment where % is any run and _ any one character."""
    wild = {"%": ".*", "_": "."}
    pattern = "".join(wild.get(c, re.escape(c)) for c in text.lower())
    return value is not None and re.search(pattern, value.lower(), re.DOTALL) is not None


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aAçÇ%_\\.*1b \n\x01", min_size=1, max_size=4))
@example("\\")
@example("%_")
def test_text_search_against_brute_force(spark, text):
    records = [(name, other, f"{10 * i:014d}") for i, name in enumerate(NAMES) for other in NAMES]
    rows = spark.createDataFrame(records, "razao_social string, nome_fantasia string, cnpj string")
    found = rows.where(search.text_matches(text)).collect()
    digits = "".join(c for c in text if c.isdigit())
    expected = [
        r for r in records
        if _like(r[0], text) or _like(r[1], text) or (digits and digits in r[2])
    ]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))


@pytest.mark.parametrize(
    "bad", [{"ordenar": "size"}, {"pagina": 0}, {"por_pagina": 0}, {"por_pagina": 501}]
)
def test_bad_searches_are_refused(bad):
    with pytest.raises(ValueError):
        search.SearchSpec(**bad)


def test_export_orders_nulls_and_limits(leads):
    sheet = export.lead_sheet(leads, limit=10)
    scores = [r["Score"] for r in sheet.collect()]
    assert len(scores) == 10 and scores == sorted(scores, reverse=True)
    assert export.lead_sheet(leads, limit=0).count() == leads.count()
    assert export.default_target("/x/", "MG") == "/x/leads_mg"


def test_dossier(spark, leads):
    debts = spark_queries._debts(spark, SF)
    owner = leads.where("dau_qtd_inscricoes > 1").orderBy("cnpj").first()
    found = dossier.find_leads(leads, [owner.cnpj_formatado])
    assert ids(found) == [owner.cnpj]
    entries = dossier.federal_entries(found, debts).orderBy("posicao").collect()
    assert [r.posicao for r in entries] == list(range(1, owner.dau_qtd_inscricoes + 1))
    values = [r.valor_consolidado for r in entries if r.valor_consolidado is not None]
    assert values == sorted(values, reverse=True)
    assert float(sum(values)) == pytest.approx(owner.dau_valor_total)
    wanted = spark.createDataFrame([(owner.cnpj_formatado,), ("00.000/0000-00",)], "cnpj string")
    assert [r.procurado for r in dossier.not_found(leads, wanted).collect()] == ["00.000/0000-00"]


def test_empty_leads(spark, leads):
    nothing = leads.limit(0)
    kpis = reports.kpi_summary(nothing).first()
    assert (kpis.total, kpis.valor_divida) == (0, 0.0)
    shares = reports.kpi_shares(nothing).collect()
    assert all(r.participacao is None and r.texto == "—" for r in shares)
    lines = reports.panorama(nothing, nothing, False).collect()
    assert lines[0].texto == "0"
    assert reports.relative_to_max(reports.top_municipalities(nothing)).count() == 0
