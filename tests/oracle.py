"""Run catalog queries in Spark and their SQL in DuckDB and compare (also a command line tool)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, kinds and rows; else what differs."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    theirs_raw = relation.fetchall()
    ours_raw = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    order = sorted(names)
    i_ours, i_theirs = [spark_df.columns.index(c) for c in order], [names.index(c) for c in order]
    ours = sorted((tuple(r[i] for i in i_ours) for r in ours_raw), key=_key)
    theirs = sorted((tuple(r[i] for i in i_theirs) for r in theirs_raw), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}; first ours {ours[:2]} theirs {theirs[:2]}"
    for a, b in zip(ours, theirs, strict=True):
        for c, x, y in zip(order, a, b, strict=True):
            if type(x) is not type(y) or (x != y and not (isinstance(x, float) and math.isnan(x) and math.isnan(y))):
                return f"{c}: {x!r} vs {y!r} in {a} / {b}"
    return None


def main(names: list[str], sf: str = "0.01") -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), duck(sf_dir), 0
    sqls = oracle_sql()
    for name, run in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            result = difference(df, con, sqls[name]) if name in sqls else f"no sql, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if result and not result.startswith("no sql"):
            bad += 1
        rows = "" if result else "ok"
        print(f"{name:32s} {time.time() - start:6.2f}s {result or rows}", flush=True)
    return bad


if __name__ == "__main__":
    flags = [a for a in sys.argv[1:] if a.startswith("sf=")]
    sys.exit(main([a for a in sys.argv[1:] if not a.startswith("sf=")], *(f[3:] for f in flags)))
