"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

    python tests/oracle_check.py [--sf 0.01] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5) + 0.0
    if v.__class__.__name__ in ("NaTType", "NAType"):
        return None
    if v.__class__.__name__ == "Decimal":
        return ("DECIMAL", str(v))
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    recs = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(recs, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark_pdf, duck_pdf) -> str | None:
    c1, r1 = _rows(spark_pdf)
    c2, r2 = _rows(duck_pdf)
    if c1 != c2:
        return f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} vs {len(r2)}"
    for c in c1:
        k1, k2 = spark_pdf[c].dtype.kind, duck_pdf[c].dtype.kind
        if k1 != k2 and not (spark_pdf[c].isna().any() or duck_pdf[c].isna().any()):
            return f"type of {c}: {spark_pdf[c].dtype} vs {duck_pdf[c].dtype}"
    for a, b in zip(r1, r2):
        for x, y, c in zip(a, b, c1):
            if x != y and not (
                isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)
            ):
                return f"{c}: {str(x)[:160]!r} vs {str(y)[:160]!r} in {str(a)[:200]} / {str(b)[:200]}"
    return None


def run(spark, sf_dir, names, queries, oracle, verbose=True):
    con, bad = duck(sf_dir), {}
    for n in names:
        t0 = time.time()
        try:
            pdf = queries[n](spark, sf_dir).toPandas()
            t1 = time.time()
            msg = compare(pdf, con.execute(oracle[n]).df()) if n in oracle else None
            if len(pdf) == 0:
                msg = (msg or "") + " EMPTY"
        except Exception as e:  # report and go on with the next query
            msg, pdf, t1 = f"{type(e).__name__}: {str(e)[:600]}", [], time.time()
        if msg:
            bad[n] = msg
        if verbose:
            kind = "sql" if n in oracle else "rows"
            print(f"{'FAIL' if msg else 'ok  '} {n:28s} {kind:4s} rows={len(pdf):6d} {t1 - t0:6.2f}s {msg or ''}", flush=True)
    return bad


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from plumbline.session import local_session

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "0.01"
    args = [a for a in args if a != "--sf"]
    q, o = queries(), oracle_sql()
    names = [n for n in q if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = run(local_session(), f"/root/testdata/sf{sf}", names, q, o)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {sorted(bad)}")
