"""Every registered query of the catalog against its DuckDB oracle on the smallest scale."""

import pytest

from tables_at import SF_SMALL

import __spark_entry__ as entry_mod
from rubric.plans import catalog, compare

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry_mod.queries())
    assert set(catalog.ORACLE) <= set(entry_mod.oracle_sql())


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n > 0
    assert df.columns == ["n", "n_correct", "n_consist", "accuracy", "consistency"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare.compare(spark, name, SF_SMALL, con)
    assert res["status"] == "ok", res
