"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import decimal
import math
from collections import Counter


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def bag(rows, columns) -> Counter:
    return Counter(tuple(norm(r[c]) for c in columns) for r in rows)


def check(spark, duck, query, sql, sf_dir) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = bag([dict(zip(names, row)) for row in cur.fetchall()], columns)
    ours = bag([r.asDict() for r in df.collect()], columns)
    assert ours == theirs, (list((ours - theirs).elements())[:3], list((theirs - ours).elements())[:3])
