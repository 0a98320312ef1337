from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from garimpo.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    quiet = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Plan checks read plans in full.
        "spark.sql.maxMetadataStringLength": "100000",
        "spark.sql.debug.maxToStringFields": "1000",
    }
    session = build_session("tests", "local[8]", 8, **quiet)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
