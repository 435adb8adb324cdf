"""Run a query and its SQL on the same Parquet tables and compare the rows."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def duck_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return names, found.fetchall()


def assert_same(df, sf_dir, sql):
    names, rows = duck_rows(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rows)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in sorted(names)]).collect())
    assert got == want
