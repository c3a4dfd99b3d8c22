"""Order-free comparison of a Spark result with a DuckDB one."""

from __future__ import annotations

import decimal


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(values, order):
    return sorted(tuple(str(norm(r[i])) for i in order) for r in values)


def assert_same(df, con, sql):
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    columns = sorted(df.columns)
    assert rows(got, [df.columns.index(c) for c in columns]) == rows(want, [names.index(c) for c in columns])
