"""Compare registered queries with their oracles: ``python -m workload.check [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from workload.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        try:
            value = value.item()
        except ValueError:
            value = list(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}")
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat() if value.tzinfo else value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def canonical(frame: pd.DataFrame):
    columns = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return columns, sorted(rows, key=repr)


def compare(expected: pd.DataFrame, got: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    ec, er = canonical(expected)
    gc, gr = canonical(got)
    if ec != gc:
        return f"columns {gc} instead of {ec}"
    if len(er) != len(gr):
        return f"{len(gr)} rows instead of {len(er)}"
    for e, g in zip(er, gr):
        if e != g or [type(x) for x in e if x is not None] != [type(x) for x in g if x is not None]:
            return f"row {dict(zip(gc, g))} instead of {dict(zip(ec, e))}"
    return None


def main(argv: list[str]) -> int:
    from shelfmark.session import local_session
    from workload import registry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
    spark, con = local_session(), connect(sf_dir)
    names = [n for n in registry.REGISTRY if not argv or any(a in n for a in argv)]
    bad = 0
    for name in names:
        q = registry.REGISTRY[name]
        start = time.time()
        try:
            got = q.run(spark, sf_dir).toPandas()
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows  {took:.2f}s", flush=True)
                continue
            problem = compare(con.execute(q.sql).df(), got)
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error)).strip()[:1500]
            took, got = time.time() - start, []
        if problem:
            bad += 1
            print(f"FAIL  {name}: {problem}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows  {took:.2f}s", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    import workload.all  # noqa: F401  (registers everything)

    sys.exit(main(sys.argv[1:]))
