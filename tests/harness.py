"""Spark query against DuckDB oracle, the way the driver compares them."""

from __future__ import annotations

import contextlib
import io
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if v is not None and type(v).__name__ == "Decimal":
        return repr(float(v))
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


# Spark type name -> DuckDB type name that a result column must have.
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
}


# Operators that no registered query may end up with.
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit")


def plan_text(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def compare(spark, con, fn, sql, sf_dir) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    plan = plan_text(df)
    banned = [op for op in BANNED if op in plan]
    if banned:
        return f"plan holds {banned}"
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want_cols, want = _rows(cols, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    for f in df.schema.fields:
        if KINDS.get(f.dataType.simpleString()) != kinds[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} != {kinds[f.name]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {[r for r in got if r not in set(want)][:2]} vs {[r for r in want if r not in set(got)][:2]}"
    if not want:
        return "no rows"
    if got != want:
        g, w = set(got), set(want)
        return f"values differ: {[r for r in got if r not in w][:3]} vs {[r for r in want if r not in g][:3]}"
    return None
