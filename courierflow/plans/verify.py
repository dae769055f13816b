"""Run a checked query on Spark and its SQL oracle on DuckDB and compare.

Comparison is order-insensitive: columns sorted by name, values normalised
(floats rounded to 6 decimals, timestamps as ISO text, arrays as lists),
rows sorted, then compared as multisets.

    python -m courierflow.plans.verify /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

from courierflow.plans.catalog import load_all
from courierflow.sources.fixtures import RAW_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    entries = load_all()
    e = entries[name]
    t0 = time.time()
    df = e.build(spark, sf_dir)
    srows = df.collect()
    scols = df.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if e.sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck_connect(sf_dir)
    cur = con.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["oracle_rows"] = len(drows)
    sc, sr = _rows(scols, [tuple(r) for r in srows])
    dc, dr = _rows(dcols, drows)
    if sc != dc:
        res["status"] = "schema-mismatch"
        res["detail"] = f"spark={sc} oracle={dc}"
    elif len(sr) != len(dr):
        res["status"] = "count-mismatch"
    elif sr != dr:
        res["status"] = "value-mismatch"
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["detail"] = repr(diff)[:800]
    else:
        res["status"] = "match"
    return res


def main(argv: list[str]) -> int:
    from courierflow.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(load_all())
    spark = build_session("local[8]", 8)
    con = duck_connect(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": "error", "detail": repr(exc)[:600]}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
