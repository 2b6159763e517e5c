"""Run the registered queries next to their DuckDB SQL and report differences.

Usage: python tools/check_oracle.py [sf dir] [name prefix ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from wayfolio import catalog  # noqa: E402
from wayfolio.fixtures import BASE  # noqa: E402
from wayfolio.session import local_session  # noqa: E402


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(canon(r[i]) for i in order) for r in rows], key=repr)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session("check")
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    oracle, bad = catalog.oracle_sql(), 0
    for name, run in catalog.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - started
            if name not in oracle:
                print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            cursor = con.execute(oracle[name])
            types = {d[0]: d[1] for d in cursor.description}
            want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            odd = [f"{c}:{t}/{types.get(c)}" for c, t in df.dtypes if _kind(t) != _kind(str(types.get(c)))]
            if names != want_names:
                bad += 1
                print(f"COLS {name}: {names} vs {want_names}", flush=True)
            elif got != want:
                bad += 1
                print(f"DIFF {name}: {len(got)} vs {len(want)} rows", flush=True)
                for a, b in [(a, b) for a, b in zip(got, want) if a != b][:3]:
                    print("   spark ", str(a)[:400], "\n   duckdb", str(b)[:400])
            else:
                print(f"ok   {name}: {len(got)} rows {took:.1f}s {odd or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:700]}", flush=True)
    print(f"{bad} problems")
    return bad


def _kind(t: str) -> str:
    t = t.lower()
    for mark, kind in (
        ("hugeint", "huge"), ("bigint", "int64"), ("int", "int32"), ("double", "double"), ("decimal", "decimal"),
        ("string", "text"), ("varchar", "text"), ("bool", "bool"), ("timestamp", "time"), ("datetime", "time"), ("date", "date"),
    ):
        if mark in t:
            return kind
    return t


if __name__ == "__main__":
    main()
