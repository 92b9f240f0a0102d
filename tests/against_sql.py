"""Runs a query on both engines and compares rows, by sorted column names."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def same(spark, tables, query, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = query(spark, tables)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    left = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in cols]
    right = sorted((tuple(tidy(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert left == right
    return len(left)
