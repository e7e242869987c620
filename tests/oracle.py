"""Compares a query's rows with its SQL's, run by DuckDB over the same files."""

from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> Counter:
    plain = lambda v: None if pd.isna(v) else bool(v) if type(v).__name__ in ("bool", "bool_") else float(v) if isinstance(v, float) else int(v) if hasattr(v, "dtype") and v.dtype.kind in "iu" else v if isinstance(v, (int, str)) else str(v)
    return Counter(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def sql(text: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c.execute(text).df()


def assert_same(found: pd.DataFrame, text: str, sf_dir: str) -> None:
    wanted = sql(text, sf_dir)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
