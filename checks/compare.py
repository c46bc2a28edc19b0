"""Run a registered query and its SQL side by side and compare the results.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = {}
    for c in df.columns:
        s = df[c]
        if str(s.dtype).startswith("datetime"):
            s = s.astype("datetime64[us]").astype(str)
        out[c] = s.map(lambda v: "<null>" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(_plain(v)))
    flat = pd.DataFrame(out, columns=list(df.columns))
    return flat.sort_values(list(flat.columns)).reset_index(drop=True) if len(flat.columns) else flat


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def diff(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = lambda d: {c: d[c].dtype.kind for c in d.columns if d[c].notna().all()}
    a, b = kinds(got), kinds(want)
    off = {c: (a[c], b[c]) for c in a if c in b and a[c] != b[c]}
    if off:
        return f"types {off}"
    x, y = _norm(got), _norm(want)
    if x.equals(y):
        return None
    bad = (x != y).any(axis=1)
    i = bad.idxmax()
    return f"{int(bad.sum())} rows differ, first: {x.loc[i].to_dict()} != {y.loc[i].to_dict()}"


def main(argv: list[str]) -> int:
    from wattframe.session import build_session

    from . import registry

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    spark = build_session(
        "compare", "local[8]", spark_sql_shuffle_partitions=8, spark_ui_enabled="false", spark_driver_memory="8g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = registry.queries(), registry.oracle_sql()
    failed = 0
    for name in argv or list(queries):
        t = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            spent = time.time() - t
            if name in oracles:
                want = con.execute(oracles[name]).df()
                d = diff(got, want)
                status = "ok" if d is None else "FAIL " + d
            else:
                status = "rows"
        except Exception as e:  # noqa: BLE001
            status, spent, got = f"ERROR {type(e).__name__}: {str(e)[:600]}", time.time() - t, []
        failed += status.startswith(("FAIL", "ERROR"))
        if not status == "ok" or "-q" not in argv:
            print(f"{name:34s} {spent:6.2f}s {len(got):8d} {status}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
