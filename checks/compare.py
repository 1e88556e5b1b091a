"""Compare registered queries with their SQL on one set of tables: ``python -m checks.compare [sf_dir] [name…]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from cardmill.session import local_session
from checks.oracles import ORACLES
from checks.queries import QUERIES


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted, so that order and integer width do not matter."""
    df = df[sorted(df.columns)]
    text = df.astype(object).where(df.notna(), None)
    for c in text.columns:
        text[c] = [
            None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in text[c]
        ]
    return text.sort_values(list(text.columns), na_position="first").reset_index(drop=True)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results, None when they are equal."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = canonical(got), canonical(want)
    wrong = (a.fillna("\0") != b.fillna("\0")).any(axis=1)
    if not wrong.any():
        return None
    return f"{int(wrong.sum())} rows differ\n{a[wrong].head(3).to_dict('records')}\n{b[wrong].head(3).to_dict('records')}"


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session("checks")
    con = duck(sf_dir)
    failed = 0
    for name, query in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = f"{time.time() - start:.1f}s"
            problem = difference(got, con.execute(ORACLES[name]).fetchdf()) if name in ORACLES else None
            print(f"{'ok  ' if not problem else 'FAIL'} {name} {len(got)} rows {took}{'' if name in ORACLES else ' (no sql)'} {problem or ''}", flush=True)
            failed += bool(problem)
        except Exception as e:
            failed += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
