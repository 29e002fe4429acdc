"""Compare every query with its SQL: `python -m gate.compare SF_DIR [query ...]`."""
from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from gate.catalog import QUERIES
from gate.oracle import ORACLE


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns by name, whole floats and integers alike."""

    def cell(x) -> str:
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "-"
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x) + 0.0:.4f}"
        text = str(x)
        return text[:10] if text.endswith(" 00:00:00") and len(text) == 19 else text

    names = sorted(frame.columns)
    return sorted(tuple(cell(x) for x in row) for row in frame[names].astype(object).itertuples(index=False, name=None))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when query and SQL agree, else what differs."""
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    extra = len(set(a) - set(b))
    return f"rows {len(a)} / {len(b)}, {extra} differ, {sorted(got.columns)}\n  spark {only_a}\n  sql   {only_b}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as failure:  # report and go on with the next query
            found = f"failed: {str(failure)[:600]}"
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - begin:.1f}s {found}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
