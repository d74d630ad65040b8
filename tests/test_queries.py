"""Every query of the core that has SQL gives the SQL's rows; the others run."""

import pytest

from pagemill.plans import general, index

QUERIES = general.QUERIES | index.QUERIES
SQL = general.SQL | index.SQL


def canonical(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(tuple(canonical(v) for v in r) for r in df.select(*columns).collect())
    assert len(set(rows)) == len(rows), "rows repeat"
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
