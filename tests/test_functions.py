from __future__ import annotations

import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from garimpo.functions import dates, identity, money
from garimpo.parameters import Parameters, ScoreWeights
from garimpo.sources.header_csv import normalise_name


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_money(spark):
    texts = ["1.234.567,89", "55,5", "10", "", None, "n/d", "1d", "NaN", "-3,25", "12 "]
    got = apply(spark, money.parse_money_br, texts)
    assert [float(v) if v is not None else None for v in got] == [
        1234567.89, 55.5, 10.0, None, None, None, None, None, -3.25, 12.0,
    ]
    texts = ["5000000,00", "1,2349", "12345678901234567,89", "1d", "NaN", "", None, " -,5 "]
    assert apply(spark, money.parse_decimal_comma, texts) == [
        5000000.0, 1.2349, 12345678901234567.89, None, None, None, None, -0.5,
    ]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.decimals("-9999999999", "9999999999", places=2), min_size=300, max_size=300))
def test_money_round_trip(spark, amounts):
    shown = apply(spark, money.format_money_br, amounts, "decimal(18,2)")
    back = apply(spark, money.parse_money_br, shown)
    assert back == [a + decimal.Decimal(0) for a in amounts]


def test_formats(spark):
    amounts = [decimal.Decimal(a) for a in ("1599380.85", "0", "999.5", "1000000")]
    assert apply(spark, money.format_money_br, amounts, "decimal(18,2)") == [
        "1.599.380,85", "0,00", "999,50", "1.000.000,00",
    ]
    assert apply(spark, money.format_thousands, [1234567, 12, 1000], "long") == [
        "1.234.567", "12", "1.000",
    ]
    assert apply(spark, money.format_reais_rounded, [1599380.5, 0.49, 2.5], "double") == [
        "R$ 1.599.381", "R$ 0", "R$ 3",
    ]


def test_identity(spark):
    assert apply(spark, identity.digits, ["10.000.001/0001-55", "x", None]) == [
        "10000001000155", "", None,
    ]
    assert apply(spark, identity.format_cnpj, ["10000001000155"]) == ["10.000.001/0001-55"]
    pairs = spark.createDataFrame(
        [("31", "33001000"), ("", "1"), ("31", ""), (None, "1"), ("31", None)], "a string, b string"
    )
    text = identity.phone(F.col("a"), F.col("b")).alias("text")
    phones = [r.text for r in pairs.select(text).collect()]
    assert phones == ["(31) 33001000", None, None, None, None]


def test_dates(spark):
    serials = [45658.0, 45658.99, 0.0, -0.5, None, 1e9]
    assert apply(spark, dates.serial_to_iso, serials, "double") == [
        "2025-01-01", "2025-01-01", "1899-12-30", "1899-12-30", None, None,
    ]
    shown = apply(
        spark,
        dates.date_br,
        ["20240131", "2024-01-31", "2024-01-31T10:00", " 20240131 ", "01/02/2025", None, "", "x"],
    )
    assert shown == [
        "31/01/2024", "31/01/2024", "31/01/2024", "31/01/2024", "01/02/2025", "—", "—", "x",
    ]
    assert apply(spark, dates.drop_sentinels, ["0", "00000000", "20240131", None, ""]) == [
        None, None, "20240131", None, "",
    ]


@given(st.text(max_size=30))
def test_normalised_names_are_plain(name):
    plain = normalise_name(name)
    assert "__" not in plain and not plain.startswith("_") and not plain.endswith("_")


def test_parameters():
    params = Parameters.from_mapping(
        {
            "uf": "sp",
            "pgfn": {"ano": 2025, "trimestre": 4},
            "mg_divida": {"janela_dias": 30},
            "universo": {"situacoes_cadastrais": ["02"], "somente_matriz": False},
            "score": {"peso_sancao": 99},
            "regime": {"capital_lucro_real": 5},
        }
    )
    assert params.uf == "SP" and params.federal_debt_folder == "2025_trimestre_04"
    assert params.situacoes_cadastrais == ("02",) and not params.somente_matriz
    assert params.weights == ScoreWeights(sancao=99)
    assert params.janela_dias == 30 and params.capital_lucro_real == 5
    assert Parameters.from_mapping({}) == Parameters()
    with pytest.raises(AttributeError):
        params.uf = "MG"
