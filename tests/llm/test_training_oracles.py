"""Registered queries next to their SQL."""

import math

import pytest

from adtally.llm.queries import oracle_sql, queries
from checks.compare import database


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", list(oracle_sql()))
@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, root, name):
    found = queries()[name](spark, root)
    columns = sorted(found.columns)
    result = database(root).execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    wanted = [plain(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted((plain(r) for r in found.select(columns).collect()), key=repr) == sorted(wanted, key=repr)
