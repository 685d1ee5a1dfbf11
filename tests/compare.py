"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def assert_same(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())
