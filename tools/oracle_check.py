"""Run registered queries on Spark and their oracle SQL on DuckDB, compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Comparison: same column names (sorted), same row count, and the same
order-insensitive hash of the rows with doubles rounded to 6 places.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from evalframe.session import TABLES, get_session  # noqa: E402


_SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE",
                "date": "DATE", "binary": "BLOB"}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return sorted(columns), len(rows), h, lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir, show=3):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    res = {"name": name, "spark_sec": round(t1 - t0, 2), "rows": len(srows)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_sec"] = round(time.time() - t1, 2)
    a, b = digest(scols, srows), digest(dcols, drows)
    ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    res["status"] = "match" if ok else "MISMATCH"
    stypes = {f.name: _SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    diff = {c: (stypes.get(c), dtypes.get(c)) for c in stypes if stypes.get(c) != dtypes.get(c)}
    if diff:
        res["type_diff"] = diff
    if not ok:
        res["spark_cols"], res["duck_cols"] = a[0], b[0]
        res["duck_rows"] = b[1]
        sa, sb = set(a[3]), set(b[3])
        res["only_spark"] = sorted(sa - sb)[:show]
        res["only_duck"] = sorted(sb - sa)[:show]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from evalframe.catalog import ORACLES, QUERIES

    spark = get_session("local[8]")
    con = duck(sf_dir)
    results = []
    for name in names or sorted(QUERIES):
        try:
            r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = {"name": name, "status": "ERROR", "error": f"{type(exc).__name__}: {str(exc)[:600]}"}
        results.append(r)
        print(json.dumps(r, ensure_ascii=False)[:2000], flush=True)
    bad = [r["name"] for r in results if r["status"] not in ("match", "no-oracle")]
    print(json.dumps({"total": len(results), "bad": bad}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
