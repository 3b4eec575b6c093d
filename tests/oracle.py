"""Runs a query and its SQL over the same tables and compares their rows."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    text = df.map(lambda x: "NULL" if x is None or (isinstance(x, float) and x != x) else repr(float(x)) if isinstance(x, float) else str(x))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    ours, theirs = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert rows(ours).equals(rows(theirs))
