"""Side-by-side run of a registered query and its SQL, used by the tests and by hand."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v) + 0.0
    return str(v)


def _family(v) -> str:
    return type(v).__name__


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; an empty list means they agree."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns {cols} vs {sorted(names)}"]
    index = [names.index(c) for c in cols]
    theirs = [tuple(_norm(r[i]) for i in index) for r in cur.fetchall()]
    mine = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    key = lambda r: tuple((v is None, _family(v), repr(round(v, 3) + 0.0) if isinstance(v, float) else repr(v)) for v in r)
    mine.sort(key=key)
    theirs.sort(key=key)
    out = []
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} vs {len(theirs)}")
    for i, c in enumerate(cols):
        kinds = {_family(r[i]) for r in mine if r[i] is not None}, {_family(r[i]) for r in theirs if r[i] is not None}
        if kinds[0] != kinds[1]:
            out.append(f"type of {c}: {kinds[0]} vs {kinds[1]}")
    for a, b in zip(mine, theirs):
        bad = [(c, x, y) for c, x, y in zip(cols, a, b) if not _close(x, y)]
        if bad:
            out.append(f"value {bad[:3]}")
            if len(out) > 4:
                break
    return out


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from gridloom.session import get_session

    sf = os.environ.get("SF", "0.01")
    d = f"/root/testdata/sf{sf}"
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    sqls = oracle_sql()
    picks = sys.argv[1:]
    for name, fn in queries().items():
        if picks and not any(p in name for p in picks):
            continue
        t = time.time()
        try:
            df = fn(spark, d)
            if name in sqls:
                res = compare(df, con, sqls[name])
                state = "ok" if not res else "DIFF " + " | ".join(res)
            else:
                state = f"rows-only {df.count()}"
        except Exception as e:  # noqa: BLE001
            state = "FAIL " + str(e)[:600]
        print(f"{name:42s} {time.time() - t:6.2f}s {state[:1500]}", flush=True)


if __name__ == "__main__":
    main()
