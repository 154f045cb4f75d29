"""Spark-vs-DuckDB parity check for the registered queries (also a CLI).

    python tests/oracle_compare.py [sf_dir] [name ...]

Compares row count, column names and a canonical value fingerprint; also
reports a tolerance comparison to tell exact mismatches from float noise.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA", object()):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return cols, out


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) if not isinstance(v, (int, float)) else (1, f"{float(v):+.6e}")
                 for v in row)


def close(a, b, tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(float(a) - float(b)) <= tol * max(1.0, abs(float(a)), abs(float(b)))
    return a == b


def compare(spark_pdf, duck_pdf):
    sc, sr = rows_of(spark_pdf)
    dc, dr = rows_of(duck_pdf)
    if sc != dc:
        return "COLS", f"spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return "ROWS", f"spark={len(sr)} duck={len(dr)}"
    ss, ds = sorted(sr, key=_key), sorted(dr, key=_key)
    exact = ss == ds
    if exact:
        return "OK", ""
    bad = [(a, b) for a, b in zip(ss, ds) if not all(close(x, y) for x, y in zip(a, b))]
    if not bad:
        return "NEAR", "float noise only"
    return "DIFF", f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"


def dtypes_match(sdf, ddf):
    return {c: str(sdf[c].dtype) for c in sdf.columns} == {c: str(ddf[c].dtype) for c in ddf.columns}


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from ladderkit.session import local_session
    spark = local_session(8, shuffle_partitions=int(os.environ.get("ORACLE_PARTITIONS", "8")))
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf)
    names = names or list(qs)
    summary = {}
    for n in names:
        t0 = time.time()
        try:
            spdf = qs[n](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            summary[n] = "SPARK_ERR"
            print(f"{n:28s} SPARK_ERR {str(e).splitlines()[0][:300]}")
            continue
        t1 = time.time()
        if n not in sqls:
            summary[n] = "ROWS_ONLY"
            print(f"{n:28s} ROWS_ONLY rows={len(spdf)} spark={t1 - t0:.2f}s")
            continue
        try:
            dpdf = con.execute(sqls[n]).df()
        except Exception as e:  # noqa: BLE001
            summary[n] = "SQL_ERR"
            print(f"{n:28s} SQL_ERR {str(e).splitlines()[0][:300]}")
            continue
        st, msg = compare(spdf, dpdf)
        types = "" if dtypes_match(spdf, dpdf) else " TYPES " + str(
            {c: (str(spdf[c].dtype), str(dpdf[c].dtype)) for c in spdf.columns
             if c in dpdf.columns and str(spdf[c].dtype) != str(dpdf[c].dtype)})
        summary[n] = st
        print(f"{n:28s} {st:5s} rows={len(spdf)} spark={t1 - t0:.2f}s {msg}{types}")
    bad = {k: v for k, v in summary.items() if v not in ("OK", "ROWS_ONLY")}
    print(f"\n{len(summary) - len(bad)}/{len(summary)} ok; not ok: {bad}")
    spark.stop()
    return 0 if not bad else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
