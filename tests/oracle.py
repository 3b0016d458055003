"""Comparison of a query with its SQL in DuckDB over one data folder."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings term_occ call_lines call_blocks labels_y preds_val_ens bankrupt_all eval_items content_labels".split()


def connect() -> duckdb.DuckDBPyConnection:
    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    def one(x: object) -> str | None:
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return f"{x:.6g}" if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(map(one, r))) for r in df.itertuples(index=False))


def compare(spark, query, sql: str) -> None:
    con = connect()
    got, want = query(spark, FOLDER).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
