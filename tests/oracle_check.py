"""Run registered queries next to their oracle SQL and compare whole results.

    python -m tests.oracle_check [sf] [name prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from plazalens import catalog
from plazalens.session import local_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con






SPARK_KIND = {"string": "text", "bigint": "int64", "int": "int32", "double": "double", "boolean": "bool", "date": "date", "timestamp": "ts"}
DUCK_KIND = {"VARCHAR": "text", "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts"}


def canonical(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "\0null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


def compare(spark, con, folder: str, name: str) -> tuple[str, str]:
    df = catalog.queries()[name](spark, folder)
    sql = catalog.oracle_sql().get(name)
    got = df.toPandas()
    if sql is None:
        return ("rows", f"{len(got)} rows, no oracle")
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchdf()
    a = {f.name: SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    b = {k: DUCK_KIND.get(v, v) for k, v in types.items()}
    if a != b:
        diff = {k: (a.get(k), b.get(k)) for k in sorted(set(a) | set(b)) if a.get(k) != b.get(k)}
        return ("SCHEMA", str(diff))
    x, y = canonical(got), canonical(want)
    if x != y:
        only_spark = [r for r in x if r not in set(y)][:3]
        only_duck = [r for r in y if r not in set(x)][:3]
        return ("DIFF", f"{len(x)} vs {len(y)} {sorted(a)}\n   spark: {only_spark}\n   duck:  {only_duck}"[:3000])
    return ("ok" if x else "EMPTY", f"{len(x)} rows")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    folder = f"/root/testdata/{sf}"
    spark, con = local_session(8), connect(folder)
    wanted = sys.argv[2:]
    bad = 0
    for name in catalog.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            status, note = compare(spark, con, folder, name)
        except Exception as problem:  # report and go on with the next query
            status, note = "ERROR", str(problem)[:1500]
        bad += status not in ("ok", "rows")
        print(f"{status:7}{name:34}{time.time() - start:6.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
