"""Run registered queries on Spark and DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, values as text, sorted."""

    def text(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "\0"
        if isinstance(value, float):
            return repr(value + 0.0)
        if hasattr(value, "isoformat"):
            return value.isoformat()[:10]
        return str(value)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False, name=None))


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both engines give the same rows, else what differs."""
    return _differences(query(spark, sf_dir).toArrow(), con, sql)


def _differences(table, con, sql: str) -> str:
    other = con.sql(sql).to_arrow_table()
    if sorted(table.column_names) != sorted(other.column_names):
        return f"columns {sorted(table.column_names)} / {sorted(other.column_names)}"
    ours, theirs = (canonical(pd.DataFrame(t.to_pydict(), dtype=object)) for t in (table, other))
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows, first {str(wrong[0])[:600]}" if wrong else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from checks.oracles import statements
    from checks.queries import QUERIES
    from checks.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = local_session(), connect(sf_dir), statements()
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in sql:
                table = QUERIES[name](spark, sf_dir).toArrow()
                took = time.time() - start
                result = _differences(table, con, sql[name]) or f"same {table.num_rows} rows, Spark {took:.1f} s"
            else:
                result = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {str(error)[:1500]}"
        print(f"{name}: {result} ({time.time() - start:.1f} s)", flush=True)
