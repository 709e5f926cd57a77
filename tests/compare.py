"""Hold a query's rows against those of its SQL."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x: object) -> object:
    return round(x, 9) if isinstance(x, float) else x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as c:
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        out = c.sql(sql)
        names = out.columns
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), [tuple(plain(r[i]) for i in order) for r in out.fetchall()]


def same(df: DataFrame, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == names
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
