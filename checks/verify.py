"""Compare every registered query with its DuckDB twin: ``python -m checks.verify [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0))
        else:
            df[c] = df[c].map(lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    off = (a != b).any(axis=1)
    if off.any():
        i = off.idxmax()
        return f"{off.sum()} of {len(a)} rows differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return "ok"


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name, build in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            got = build(spark, sf_dir).toPandas()
            took = time.time() - start
            result = "rows only" if name not in ORACLES else compare(got, con.execute(ORACLES[name]).df())
        except Exception as e:  # report and go on with the next query
            took, got, result = time.time() - start, [], "ERROR " + str(e).split("JVM stacktrace")[0][:600]
        failed += result not in ("ok", "rows only")
        print(f"{name:28s} {took:6.1f}s {len(got):7d} {time.time() - start - took:5.1f}s  {result}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
