"""A query's rows against its SQL in DuckDB."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def same_rows(df, sql, sf_dir=SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    table = con.sql(sql)
    names = [d[0] for d in table.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    at = [names.index(c) for c in columns]
    theirs = sorted(str([plain(r[i]) for i in at]) for r in table.fetchall())
    assert ours == theirs
