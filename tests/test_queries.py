"""Every core query with SQL against that SQL, and every other one for a stable schema."""

from __future__ import annotations

import pytest

from sentrail import queries as Q
from tests.oracle import compare

QUERIES = {n: f for m in Q.modules() for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in Q.modules() for n, s in m.ORACLES.items()}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    compare(spark, data, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.collect()) > 0 and df.columns


def test_batch_and_stream_admit_alike(spark, data):
    a, b = QUERIES["str2_admitted"](spark, data), QUERIES["str2_admitted_stream"](spark, data)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_entry_without_the_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
