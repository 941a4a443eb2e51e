"""Every catalogue query that has SQL against it in a second engine (digit_segments has a loop in test_glyphs)."""

import decimal

import pytest

from marketlens.plans import catalogue, layers, pages, shading  # noqa: F401  (the others add their queries)
from tests.conftest import DATA


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool) or v is None or isinstance(v, (str, float)):
        return v
    return float(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")
    r = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    want = sorted((tuple(plain(row[columns.index(c)]) for c in sorted(columns)) for row in r.fetchall()), key=key)
    got = sorted((tuple(plain(row[c]) for c in sorted(columns)) for row in df.collect()), key=key)
    assert got == want
