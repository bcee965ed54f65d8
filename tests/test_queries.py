"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from findlake.registry import ORACLE_SQL, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = oracle.rows(df.columns, df.collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == oracle.rows(names, result.fetchall())


def test_registered_names_leave_the_numbered_operators_free():
    assert not [n for n in QUERIES if n.startswith("op")]
