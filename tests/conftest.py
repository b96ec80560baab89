from __future__ import annotations

import os

import pytest

from sentrail.session import local_session

os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("SENTRAIL_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "sentrail-tests", "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA
