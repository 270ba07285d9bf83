"""Order-free comparison of a Spark result with a DuckDB result."""

import datetime
import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(df, con, sql):
    names = sorted(df.columns)
    mine = [tuple(plain(row[n]) for n in names) for row in df.collect()]
    found = con.execute(sql)
    theirs_names = [c[0] for c in found.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = [tuple(plain(row[i]) for i in at) for row in found.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)
