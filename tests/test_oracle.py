"""Every registered query with an oracle matches DuckDB at sf0.001."""

import pytest

from issuelens.plans.check import compare
from tests.conftest import SF_SMALL


def test_entry_contract(spark):
    import __spark_entry__ as E

    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0
    assert {"number", "complexity", "confidence"} <= set(df.columns)


@pytest.mark.slow
def test_all_oracles_sf0001(spark):
    report = compare(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in report.items() if not v["ok"]}
    assert not bad, bad
