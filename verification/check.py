"""Compare every registered query with its SQL: ``python -m verification.check DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from verification.oracle import ORACLE
from verification.queries import QUERIES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # Generated code that does not compile is an error here, not a silent slow path.
        .config("spark.sql.codegen.fallback", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(value: object) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, db: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    made = QUERIES[name](spark, folder)
    plan = made._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "CartesianProduct" in plan:
        return "the plan holds a join of all with all"
    ours = rows_of(made.columns, [tuple(r) for r in made.collect()])
    if name not in ORACLE:
        return None if ours else "no rows"
    result = db.sql(ORACLE[name])
    theirs = rows_of(result.columns, result.fetchall())
    if sorted(made.columns) != sorted(result.columns):
        return f"columns {sorted(made.columns)} against {sorted(result.columns)}"
    types = {f.name: f.dataType.simpleString() for f in made.schema}
    known = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
    off = [f"{c}: {types[c]} against {t}" for c, t in zip(result.columns, result.types) if known.get(types[c]) != str(t)]
    if ours != theirs:
        mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{len(ours)} against {len(theirs)} rows\n   ours {sorted(mine)[:2]}\n   sql  {sorted(other)[:2]}"
    return f"types {off}" if off else None


def main() -> int:
    folder, only = sys.argv[1], sys.argv[2:]
    spark, db, failed = session(), database(folder), 0
    for name in QUERIES:
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - start:.1f} s)", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
