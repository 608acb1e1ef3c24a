"""Spark-vs-DuckDB comparison used by the tests and by hand.

Runs a registered Spark query and its oracle SQL on the same parquet tables
and compares column names, row counts and the multiset of normalised rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE",
                 "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
                 "timestamp_ntz": "TIMESTAMP", "binary": "BLOB", "float": "FLOAT", "tinyint": "TINYINT"}


def type_mismatches(df, res):
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    duck_types = {c: str(t) for c, t in zip(res.columns, res.types)}
    return {c: (spark_types[c], duck_types.get(c)) for c in spark_types
            if c in duck_types and spark_types[c] != duck_types[c]}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], [columns[i] for i in order]


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None):
    """Return a dict with the verdict of one query."""
    t0 = time.time()
    df = query(spark, sf_dir)
    s_rows = df.collect()
    t_spark = time.time() - t0
    s_cols = df.columns
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    t0 = time.time()
    res = con.sql(sql)
    o_cols = res.columns
    types = type_mismatches(df, res)
    o_rows = res.fetchall()
    out["oracle_sec"] = round(time.time() - t0, 2)
    out["oracle_rows"] = len(o_rows)
    a, ac = rows_of(s_cols, s_rows)
    b, bc = rows_of(o_cols, o_rows)
    if ac != bc:
        out["status"] = "columns differ"
        out["detail"] = {"spark_only": sorted(set(ac) - set(bc)), "oracle_only": sorted(set(bc) - set(ac))}
        return out
    ca, cb = Counter(a), Counter(b)
    if ca == cb and types:
        out["status"] = "types differ"
        out["detail"] = types
    elif ca == cb:
        out["status"] = "match"
    else:
        out["status"] = "values differ"
        only_a = list((ca - cb).elements())[:3]
        only_b = list((cb - ca).elements())[:3]
        out["detail"] = {"columns": ac, "spark_only": only_a, "oracle_only": only_b,
                         "n_spark_only": sum((ca - cb).values()), "n_oracle_only": sum((cb - ca).values())}
    return out


def main(argv):
    import __spark_entry__ as E
    from commitlens.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        try:
            res = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as exc:  # noqa: BLE001
            res = {"name": name, "status": "error", "detail": repr(exc)[:600]}
        if res["status"] not in ("match", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
