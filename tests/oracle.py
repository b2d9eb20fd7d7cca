"""Compares a query's rows with those of DuckDB SQL on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def duck(sql: str, sf_dir: str = SF_DIR) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    names = [c[0] for c in con.execute(f"describe {sql}").fetchall()]
    return names, con.execute(sql).fetchall()


def _norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def rows(names: list[str], found: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([_norm(r[k]) for k in order]) for r in found)


def check(spark, query, sql: str, sf_dir: str = SF_DIR) -> int:
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    names, expected = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, expected)
    return len(got)
