"""The pipeline's stages, one after the other, against plain versions of their decisions."""

import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from wayfolio.fixtures import BASE  # noqa: E402
from wayfolio.llm import catalog  # noqa: E402
from wayfolio.llm.common import stored, table  # noqa: E402
from samples import space_words  # noqa: E402
from test_learned import plain_components  # noqa: E402
from test_plain import plain_hits  # noqa: E402


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, (_, after) in seen.items():
        assert after.columns == (columns + ["shard"] if name == "sharding" else columns)
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    before, after = seen["language_id"]
    assert before.count() == after.count()  # every text here has letters of a known language
    before, after = seen["near_duplicates"]
    assert sorted(repr(d) for d, _ in rows(after)) == sorted({c for _, _, c in plain_components(rows(before), 5, 80)})
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert sorted(d for d, _ in rows(after)) == sorted(r[0] for r in plain_hits(rows(before), items) if not r[-1])
    before, after = seen["mixing"]
    words = sum(len(space_words(t)) for _, t in rows(before))
    assert abs(sum(len(space_words(t)) for _, t in rows(after)) - 1.5 * words) <= before.select("source").distinct().count()
    before, after = seen["sharding"]
    assert sorted(rows(before)) == sorted(rows(after))


def test_run_is_the_stages(spark):
    assert "shard" in corpus_pipeline.run(spark, SMALL).columns


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SMALL)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{i}" for i in range(1, 14)]
