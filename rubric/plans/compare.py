"""Run a registered query in Spark and its oracle in DuckDB; compare.

Used by the tests and by hand.  Comparison: same column names, same row
count, same multiset of rows (columns sorted by name, values normalised).
"""

from __future__ import annotations

import math
import os

from .catalog import ORACLE, QUERIES
from ..sources.tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


# Spark type -> DuckDB type of the same values
TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
            "smallint": "SMALLINT", "date": "DATE"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = {"name": name, "spark_rows": len(s_rows)}
    if name not in ORACLE:
        res["status"] = "no-oracle"
        return res
    rel = con.sql(ORACLE[name])
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    type_diffs = [(c, t, d_types[c]) for c, t in sdf.dtypes if TYPE_MAP.get(t, t) != d_types[c]]
    if type_diffs:
        res["status"] = f"types differ: {type_diffs}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        res["status"] = "ok"
    else:
        sa, sb = set(a), set(b)
        res["status"] = "values differ"
        res["only_spark"] = list(sa - sb)[:3]
        res["only_oracle"] = list(sb - sa)[:3]
    return res
