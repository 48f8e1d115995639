"""Order-insensitive comparison of a query's rows with its SQL."""

import datetime


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def same(df, duck, sql):
    columns = sorted(df.columns)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
