"""Spark results against DuckDB SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


def same_rows(spark, folder: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)
