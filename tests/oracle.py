"""Compares a registered query with its SQL in DuckDB."""

import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = query(spark, sf_dir)
    got = rows(found.columns, found.collect())
    ran = db.execute(sql)
    want = rows([c[0] for c in ran.description], ran.fetchall())
    return got, want


def differ(got, want):
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        return f"{len(got[1])} and {len(want[1])} rows; " + str([x for x in zip(got[1], want[1], strict=False) if x[0] != x[1]][:2])
    return ""
