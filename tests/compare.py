"""Rows of a Spark query and of its SQL, in a form that can be compared."""

import decimal
import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v)


def rows_of(rows, names):
    return sorted(([plain(r[n]) for n in names] for r in rows), key=repr)


def same(df, con, sql):
    found = [r.asDict() for r in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    assert rows_of(found, names) == rows_of(wanted, names)
