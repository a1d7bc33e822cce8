"""Every query with SQL gives that SQL's rows."""

from __future__ import annotations

import oracle
import pytest

from tallymark import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert oracle.difference(Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.oracle_sql()[name]).df()) == ""


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "verdict_counts" in e.queries()
    assert ("pipeline" in e.queries()) == (e.llm is not None) == any(n.startswith("op1_") for n in e.queries())
