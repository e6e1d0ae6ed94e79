"""Row comparison used by the oracle tests (order-insensitive, floats to 6 digits)."""

import math


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (repr(v) if v == 0 else round(v, 6))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql, cols):
    rel = con.sql(sql)
    dcols = rel.columns
    assert sorted(dcols) == cols, f"columns differ: {sorted(dcols)} vs {cols}"
    idx = [dcols.index(c) for c in cols]
    return sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
