"""Runs queries against their SQL in DuckDB the way the correctness gate does: sorted columns, any row order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sightline.session import TABLES, session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr), [names[k] for k in order]


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, name, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    got, columns = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want, names = rows_of([x[0] for x in result.description], result.fetchall())
    if columns != names:
        return f"columns {columns} and {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(args):
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con, failed = session(), duck(sf_dir), 0
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        began = time.time()
        try:
            if name in sql:
                why = compare(spark, name, query, sql[name], sf_dir, con)
                said = why or "ok"
            else:
                df = query(spark, sf_dir)
                why, said = None, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            why = said = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(why)
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
