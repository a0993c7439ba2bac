"""Running a registered query and its SQL side by side."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    """What keeps two results from holding the same rows, in any order."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} vs {len(theirs)}"]
    a, b = _sorted(ours), _sorted(theirs)
    out = []
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = (~same).to_numpy().nonzero()[0][:3]
            out.append(f"{c}: {(~same).sum()} differ, e.g. {[(x.iloc[i], y.iloc[i]) for i in at]}")
    return out


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu":
            df[c] = df[c].astype("float64")
        elif df[c].dtype.kind == "O":
            number = df[c].map(
                lambda v: v is None or isinstance(v, (int, float)) and not isinstance(v, bool)
            )
            if number.all():
                df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)
