"""Run a registered query and its SQL twin on the same files and compare."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value != 0 else "0.0"
    if isinstance(value, (list, tuple)):
        return repr([_cell(v) for v in value])
    if isinstance(value, dict):
        return repr(sorted((k, _cell(v)) for k, v in value.items()))
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, folder, show=3):
    """What differs, as text; empty if the results are the same."""
    df = query(spark, folder)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if ours == theirs:
        return "" if ours else "both results are empty"
    only_ours = sorted(set(ours) - set(theirs))[:show]
    only_theirs = sorted(set(theirs) - set(ours))[:show]
    return f"{len(ours)} rows vs {len(theirs)}\n  spark: {only_ours}\n  sql:   {only_theirs}"
