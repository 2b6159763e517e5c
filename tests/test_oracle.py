"""Every registered query next to its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import rows_of  # noqa: E402
from conftest import SMALL  # noqa: E402

from wayfolio import catalog  # noqa: E402
from wayfolio.fixtures import BASE  # noqa: E402

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_inventory_id_is_registered():
    ids = {name.split("_")[0] for name in catalog.queries()}
    sizes = {"a": 12, "b": 44, "c": 14, "d": 23, "e": 25, "f": 18, "g": 8, "h": 8, "j": 2}
    missing = [f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1) if f"{k}{i}" not in ids]
    assert not missing and "i" in ids
