"""Order-insensitive comparison of a Spark query with DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, fn, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    df = fn(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, got) == rows_of(names, want)
    return len(got)
