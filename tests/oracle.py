"""Comparing a query's rows with those of DuckDB's SQL over the same files."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "null" if x is None or x != x else str(round(x, 6)) if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def assert_same(rows: pd.DataFrame, sql: str, sf_dir: str) -> None:
    pd.testing.assert_frame_equal(plain(rows), plain(sql_rows(sql, sf_dir)))
