import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wayfolio.fixtures import Tables  # noqa: E402
from wayfolio.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", shuffle=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture()
def column(spark):
    """Evaluate a column function on literal values: column(fn, value, ...) -> list of results."""
    def run(fn, *values, schema="v string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        names = [c for c in df.columns if c != "i"]
        return [r[0] for r in df.orderBy("i").select(fn(*names).alias("r")).collect()]

    return run
