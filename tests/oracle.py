"""Runs registered queries next to their SQL and compares them value by value."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def make_session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cores}]").appName("sessionloom-tests")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else (round(v, 9) if isinstance(v, float) else str(v)))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(spark, con, name: str, sf_dir: str, allow_empty: bool = False) -> str | None:
    """None when equal, else what differs; two empty results count as equal only with ``allow_empty``."""
    from sessionloom.plans.catalog import REGISTRY

    function, text = REGISTRY[name]
    started = time.time()
    got = function(spark, sf_dir).toPandas()
    middle = time.time()
    if text is None:
        return None if len(got) else "no rows"
    want = con.execute(text).fetchdf()
    print(f"{name}: rows={len(got)} spark={middle - started:.1f}s sql={time.time() - middle:.1f}s", flush=True)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return None if allow_empty else "no rows"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        kinds = (a[c].dtype.kind, b[c].dtype.kind)
        if kinds[0] != kinds[1]:
            return f"column {c}: type {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same[~same].index[0]
            return f"column {c}: {(~same).sum()} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    scale = sys.argv[1]
    folder = f"/root/testdata/sf{scale}"
    session, connection = make_session(), connect(folder)
    session.sparkContext.setLogLevel("ERROR")
    from sessionloom.plans.catalog import REGISTRY

    for query in sys.argv[2:] or list(REGISTRY):
        try:
            problem = difference(session, connection, query, folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(("OK   " if problem is None else "FAIL ") + query + ("" if problem is None else ": " + problem), flush=True)
