"""Compare every query with its SQL on one scale: ``python tests/verify.py sf0.01 [name ...]``."""

import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as e  # noqa: E402

TESTDATA = "/root/testdata"


def connect(folder):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    rows = sorted((tuple(str(v) for v in r) for r in df.itertuples(index=False, name=None)))
    return rows


def compare(spark, con, name, folder):
    """None if equal, else what differs."""
    started = time.time()
    got = e.queries()[name](spark, folder).toPandas()
    took = time.time() - started
    want = con.execute(e.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", took, len(got)
    a, b = canonical(got), canonical(want)
    if a == b:
        return None, took, len(got)
    extra = [r for r in a if r not in set(b)][:2]
    missing = [r for r in b if r not in set(a)][:2]
    return f"rows {len(a)} vs {len(b)}; only spark {extra}; only sql {missing}", took, len(got)


if __name__ == "__main__":
    folder = f"{TESTDATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crosstally-verify-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = sys.argv[2:] or list(e.queries())
    bad = 0
    for name in names:
        try:
            problem, took, n = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            problem, took, n = f"{type(error).__name__}: {str(error)[:600]}", 0, 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} rows={n:7d} {took:6.2f}s {problem or ''}"[:1500], flush=True)
    missing = set(e.queries()) ^ set(e.oracle_sql())
    print(f"{len(names) - bad}/{len(names)} equal; without counterpart: {sorted(missing)}")
