"""python tests/run_oracle.py [NAME...]: every query beside its SQL, on one table folder (ORACLE_DIR)."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def compare(df, c, sql: str) -> str:
    """Empty if the rows are the same, else what differs."""
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[k]) for k in cols) for r in df.collect())
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(k) for k in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {cols} {bad[:2]}" if bad else ""


def main() -> int:
    import __spark_entry__ as entry
    from loomgraph.session import session

    spark = session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
    c, queries, sqls = connect(sf_dir), entry.queries(), entry.oracle_sql()
    names, failed = sys.argv[1:] or list(queries), 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = compare(df, c, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + " ".join(str(e).split())[:600] if "-v" not in sys.argv else traceback.format_exc()
        bad = bool(said) and not said.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok'} {name} {time.time() - began:.1f}s {said}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
