"""Run registered queries beside their SQL and compare rows, names and types."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from riskloom.plans.queries import QUERIES, oracle_sql
from riskloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "InPandas"]


def bad_nodes(df) -> list[str]:
    """Plan nodes that would not survive large inputs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [node for node in FORBIDDEN if node in plan]


def difference(spark, con, name: str, folder: str) -> str | None:
    """None if both sides agree and the plan is sound, else what differs."""
    df = QUERIES[name](spark, folder)
    if bad_nodes(df):
        return f"plan holds {bad_nodes(df)}"
    relation = con.sql(oracle_sql()[name])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sql_types = dict(zip(relation.columns, (str(t) for t in relation.types)))
    if set(types) != set(sql_types):
        return f"columns {sorted(types)} != {sorted(sql_types)}"
    wrong = {c: (t, sql_types[c]) for c, t in types.items() if SAME_TYPE.get(t) != sql_types[c]}
    if wrong:
        return f"types {wrong}"
    ours, theirs = canonical(df.toPandas()), canonical(relation.df())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        if str(a.dtype).startswith("datetime"):
            a, b = a.astype("datetime64[us]"), b.astype("datetime64[us]")
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} of {len(a)} in {c}: {a[i]!r} != {b[i]!r} at {ours.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    chosen = sys.argv[2:] or list(QUERIES)
    for name in chosen:
        start = time.time()
        try:
            if name in oracle_sql():
                result = difference(session, con, name, folder)
            else:
                result = None if QUERIES[name](session, folder).toPandas().shape[0] else "no rows"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok  " if result is None else "FAIL"
        print(f"{mark} {name:24s} {time.time() - start:6.2f}s {result or ''}", flush=True)
