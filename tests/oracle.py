"""Runs a query's SQL with DuckDB over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(spark_df):
    names = sorted(spark_df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=repr)


def expected(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    r = c.execute(sql)
    columns = [d[0] for d in r.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
