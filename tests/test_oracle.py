"""Every registered query against its DuckDB twin at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_compare import compare, duck_conn

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_CHECK)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], SQL[name], SF_CHECK)
    assert r.get("ok"), r


def test_every_query_has_an_oracle():
    from traitgrid.plans.oracle import SQL as OWN
    from traitgrid.plans.queries import QUERIES
    assert set(QUERIES) == set(OWN)  # the corpus operators are tested in their own folder


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "value", "trait", "n_keyed", "n_valid", "n_na", "mean", "std"]
    assert df.count() > 0


def test_roundtrip_at_smoke_scale(spark):
    assert E.queries()["columns_json_roundtrip"](spark, SF_SMALL).count() == 200
