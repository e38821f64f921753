"""Compare a registered query with its SQL on the same tables."""
from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _kind(dtype: str) -> str:
    d = str(dtype)
    return "int" if d.startswith(("int", "Int", "uint")) else "float" if d.startswith("float") else d


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    key = frame.astype(str)
    return frame.iloc[key.sort_values(list(frame.columns)).index if len(frame) else []].reset_index(drop=True)


def compare(spark_df, sql: str, con) -> str | None:
    """None when equal, else what differs."""
    got = spark_df.toPandas().reset_index(drop=True)
    want = con.execute(sql).fetch_df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if _kind(a.dtype) != _kind(b.dtype) and not (a.isna().any() or b.isna().any()):
            return f"type of {c}: {a.dtype} != {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = int((~same).idxmax())
            return f"{c}: {int((~same).sum())} of {len(a)} differ, e.g. {a[i]!r} != {b[i]!r}\n{got.loc[i].to_dict()}\n{want.loc[i].to_dict()}"
    return None
