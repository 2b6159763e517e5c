"""Streams that can be restarted, loads that can be repeated, history and context."""

import re

import pytest
from pyspark.sql import functions as F

from wayfolio.catalog.source_queries import FILE_PAGES, _landed_pages, _pages_of
from wayfolio.fixtures import Tables
from wayfolio.operators.dedupe import dedupe_incoming
from wayfolio.plans import conversations as C
from wayfolio.plans import library as L
from wayfolio.plans.context import build_context, passages_for_terms
from wayfolio.plans.ingest import capped_fill, missing_image_worklist, pending, select_targets
from wayfolio.session import balanced_stream, scratch_path
from wayfolio.sources.json_rows import EVENT_SEED, read_corpus, read_records_json
from wayfolio.sources.tables import available_columns, conform
from wayfolio.streaming.place_stream import ingest_stream, progress_table

SCHEMA = "arrival long, target_id int, outcome string, a string, b string"


def keys():
    return {"a": F.col("a"), "b": F.col("b")}


def run(spark, paths):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(paths["landed"])
    query = ingest_stream(source, paths["store"], paths["progress"], paths["checkpoint"], keys())
    query.awaitTermination()
    return query


def land(spark, paths, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(paths["landed"])


def test_batches_equal_one_pass_and_survive_a_restart(spark):
    paths = {n: scratch_path(spark, n) for n in ("landed", "store", "progress", "checkpoint")}
    first = [(1, 0, "candidate", "k1", None), (2, 0, "candidate", "k1", "k2"), (3, 1, "unnamed", None, None)]
    second = [(4, 0, "candidate", None, "k2"), (5, 1, "candidate", "k1", "k9"), (6, 1, "candidate", None, "k9")]
    third = [(7, 1, "candidate", "k7", "k2"), (8, 1, "candidate", "k8", None)]
    land(spark, paths, first)
    land(spark, paths, second)
    run(spark, paths)
    land(spark, paths, third)
    run(spark, paths)
    run(spark, paths)
    stored = {r.arrival for r in spark.read.parquet(paths["store"]).collect()}
    everything = spark.createDataFrame(first + second + third, SCHEMA).filter("outcome = 'candidate'").drop("outcome")
    want = {r.arrival for r in dedupe_incoming(everything, None, keys()).filter("outcome = 'accepted'").collect()}
    assert stored == want == {1, 4, 6, 8}
    progress = {r.target_id: (r.fetched, r.duplicates, r.candidates, r.last_batch) for r in progress_table(spark, paths["progress"]).collect()}
    assert progress == {0: (3, 1, 2, 1), 1: (5, 2, 2, 2)}


def test_load_sections_is_idempotent(spark):
    parsed = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "book_id string, chapter_number int")
    existing = spark.createDataFrame([("b", 1, 10), ("b", 2, 20)], "book_id string, chapter_number int, section_id int")
    passages = spark.createDataFrame([(10, 1)], "section_id int, verse_number int")
    plan = {r.chapter_number: r.action for r in L.load_sections(parsed, existing, passages).collect()}
    assert plan == {1: "keep", 2: "fill", 3: "insert"}
    stored = existing.union(spark.createDataFrame([("b", 3, 30)], existing.schema))
    loaded = passages.union(spark.createDataFrame([(20, 1), (30, 1)], passages.schema))
    assert {r.action for r in L.load_sections(parsed, stored, loaded).collect()} == {"keep"}


def test_repair_keeps_the_earliest_complete_version(spark):
    expected = spark.createDataFrame([("b", 1, 2)], "book_id string, chapter_number int, expected int")
    existing = spark.createDataFrame([("b", 1, 1, 5), ("b", 1, 2, 6), ("b", 1, 3, 7)], "book_id string, chapter_number int, section_id int, created_at int")
    passages = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)], "section_id int, verse_number int")
    assert {r.section_id: r.action for r in L.repair_sections(expected, existing, passages).collect()} == {1: "drop", 2: "keep", 3: "drop"}


def test_ensure_book(spark):
    meta = spark.createDataFrame([(3, "T"), (2, "T"), (4, "Old")], "book_id int, title string")
    existing = spark.createDataFrame([(1, "Old")], "book_id int, title string")
    assert sorted(tuple(r) for r in L.ensure_book(meta, existing).collect()) == [(1, "Old"), (2, "T")]


def test_history(spark):
    rows = [(1, 0, "assistant", "early"), (1, 1, "user", "Q"), (1, 2, "system", "s"), (1, 3, "assistant", "A"), (1, 4, "user", ""), (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    pairs = C.qa_pairs(df).collect()
    assert [(p.conv_id, p.question, p.answer, p.title) for p in pairs] == [(1, "Q", "A", "Q")]
    assert {r.conv_id: r.history for r in C.history_tail(df, 3).collect()}[1] == "User: Q\nAssistant: A\nUser: "
    assert {r.conv_id: r.history for r in C.assistant_tail(df, 3).collect()}[1] == "Assistant: s\nAssistant: A"
    conversations, messages = C.exchange_rows(
        spark.createDataFrame([(1, 7, "Q", "A"), (2, None, "Q", "A"), (3, 7, " ", "A")], "conv_id int, user_id int, question string, answer string")
    )
    assert conversations.count() == 1 and [r.role for r in messages.orderBy("turn").collect()] == ["user", "assistant"]


def test_terms_match_inside_words(spark):
    passages = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Peaceful day", "war, PEACE!", "pea ce", "xpeacex", "peac"])], "section_id int, line_no int, content string")
    terms = spark.createDataFrame([("peace",), ("cefu",)], "term string")
    rows = passages_for_terms(terms, passages, 2).collect()
    assert sorted((r.term, r.line_no) for r in rows) == [("cefu", 0), ("peace", 0), ("peace", 1)]


def test_context_drops_empty_sections(spark):
    questions = spark.createDataFrame([("q", None, "tell of peace", 10.0, 20.0)], "question_id string, user_id int, message string, lat double, lng double")
    named = spark.createDataFrame([("Islam", "About")], "name string, description string")
    books = spark.createDataFrame([], "title string, description string")
    passages = spark.createDataFrame([(1, 0, 1, "peace here", "T", 2)], "section_id int, line_no int, verse_number int, content string, title string, chapter_number int")
    prayers = spark.createDataFrame([], "id int, title string, category string, content string")
    places = spark.createDataFrame([(1, "Hall", "Islam", "", "Land", 10.0, 20.0, None)], "id int, name string, religion string, city string, country string, latitude double, longitude double, description string")
    favorites = spark.createDataFrame([], "favorite_id int, user_id int, section_id int, verse_number int")
    row = build_context(questions, named, books, passages, prayers, places, favorites).first()
    assert row.term == "tell"
    questions = questions.withColumn("message", F.lit("of peace"))
    row = build_context(questions, named, books, passages, prayers, places, favorites).first()
    assert row.context == (
        "### Religions\n- Islam - About\n\n### Relevant Verses\n- T 2:1 - peace here\n\n"
        "### Temples and Sacred Places\n- Hall - Islam - Land\n\n### Nearby Temples\n- Hall - Islam - Land - 0.0 km away"
    )


def test_worklists(spark):
    targets = spark.createDataFrame([(1, "New York"), (2, "Rome")], "target_id int, name string")
    chosen, unknown = select_targets(targets, [" new_york ", "Atlantis"])
    assert [r.target_id for r in chosen.collect()] == [1] and [r.requested for r in unknown.collect()] == ["Atlantis"]
    assert select_targets(targets, ["Nowhere"])[0].count() == 2
    progress = spark.createDataFrame([(1, "completed_with_errors")], "target_id int, status string")
    assert [r.target_id for r in pending(targets, progress, 5).collect()] == [2]
    assert pending(targets, progress, 5, force=True).count() == 2
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)], "g string, n int")
    assert [tuple(r) for r in capped_fill(rows, "g", "n", 3, 4).collect()] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    images = spark.createDataFrame([(1, "z", None), (2, "a", ""), (3, "b", None), (4, "c", "x")], "id int, name string, image_url string")
    assert [r.id for r in missing_image_worklist(images, 3).collect()] == [3, 1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "events.json").write_text('[{"religion":"Islam","title":"Eid","event_date":"2026-03-20","is_global":true},{"title":"X"}]')
    rows = read_records_json(spark, str(tmp_path / "events.json"), EVENT_SEED).collect()
    assert [(r.title, str(r.event_date), r.is_global) for r in rows] == [("Eid", "2026-03-20", True), ("X", "None", None)]
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "a.txt").write_text("one\ntwo")
    assert [r.text for r in read_corpus(spark, str(texts)).collect()] == ["one\ntwo"]
    df = spark.createDataFrame([(1, "x", 2.0)], "id int, name string, extra double")
    assert available_columns(df, ["name", "phone"]) == ["name"]
    target = spark.createDataFrame([], "id long, name string, note string").schema
    assert conform(df, target, ["id"]).dtypes == [("id", "bigint"), ("name", "string")]
    try:
        conform(df, target, ["id", "note"])
        raise AssertionError("a missing required column must fail")
    except ValueError as error:
        assert "note" in str(error)


def test_word_index_is_refreshed_and_replayed(spark, tmp_path):
    from wayfolio.operators import word_index as W

    schema, path = "section_id long, line_no int, content string", str(tmp_path / "index")
    old = spark.createDataFrame([(s, n, f"Mercy and lovingkindness {s} {n}") for s in range(5, 9) for n in range(3)], schema)
    new = spark.createDataFrame([(1, 0, "unkind words"), (2, 0, "kindling, Kindness"), (3, 0, None), (3, 1, ""), (9, 0, "merciful")], schema)
    terms = spark.createDataFrame([("kind",), ("kindness",), ("merc",), ("absent",)], "term string")
    W.add_to_word_index(old, path, "1", 4)
    before = sorted(map(tuple, W.lookup(terms, W.read_word_index(spark, path, 4), 4).collect()))
    assert before == sorted(map(tuple, passages_for_terms(terms, old, 4).collect())) and len(before) == 12
    for _ in range(2):  # a batch that is replayed changes nothing
        W.add_to_word_index(new, path, "2", 4)
        after = sorted(map(tuple, W.lookup(terms, W.read_word_index(spark, path, 4), 4).collect()))
        assert after == sorted(map(tuple, passages_for_terms(terms, old.unionAll(new), 4).collect()))
    assert {r[1] for r in after if r[0] == "kind"} == {1, 2, 5}
    with pytest.raises(ValueError):
        W.lookup(terms, W.read_word_index(spark, path, 4), 5)
    with pytest.raises(FileNotFoundError):
        W.read_word_index(spark, str(tmp_path / "nothing"), 4)


def test_a_lookup_does_not_read_passages(spark, tmp_path, tables):
    from wayfolio.operators import word_index as W

    path = str(tmp_path / "index")
    W.add_to_word_index(tables("passages"), path, "1", 8)
    terms = spark.createDataFrame([("tion",), ("ring",)], "term string")
    found = passages_for_terms(terms, None, 8, W.read_word_index(spark, path, 8))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, passages_for_terms(terms, tables("passages"), 8).collect()))


@pytest.fixture()
def worded(spark):
    """60 sections of three lines and one without an id: common words, rarer ones, words that hold others."""
    lines = [(n, k, f"Common{n % 3} kind mankind{n % 7} rare{n:03d}x {'unkindly' if n > 50 else ''}") for n in range(60) for k in range(3)]
    return spark.createDataFrame([*lines, (None, 0, "kind rare001x")], "section_id long, line_no int, content string")


TERMS = ["kind", "mankind", "kindly", "common2", "rare", "rare05", "rare001x", "none"]


def plain_first(passages, terms, limit):
    rows = sorted(passages.collect(), key=lambda r: (r.section_id is not None, r.section_id, r.line_no))
    hits = {t: [(t, r.section_id, r.line_no) for r in rows if t in r.content.lower()][:limit] for t in terms}
    return sorted((h for own in hits.values() for h in own), key=str)


@pytest.mark.parametrize("early, most", [(2, 500_000), (2, 1), (30, 500_000), (1000, 500_000)])
def test_terms_settled_in_the_first_sections(spark, worded, monkeypatch, early, most, tmp_path):
    from wayfolio.operators import word_index as W

    monkeypatch.setattr(W, "EARLY", early)
    monkeypatch.setattr(W, "FEW", most)
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = plain_first(worded, TERMS, 4)
    assert sorted(map(tuple, passages_for_terms(terms, worded, 4).collect()), key=str) == want
    path = str(tmp_path / "index")
    W.add_to_word_index(worded.filter("section_id % 2 = 0"), path, "1", 4)
    W.add_to_word_index(worded.filter("section_id is null or section_id % 2 = 1"), path, "2", 4)
    assert sorted(map(tuple, W.lookup(terms, W.read_word_index(spark, path, 4), 4).collect()), key=str) == want


def test_a_passing_index_keeps_no_more_than_it_needs(worded, monkeypatch):
    from wayfolio.operators import word_index as W

    monkeypatch.setattr(W, "EARLY", 5, raising=False)
    posted = W.passing_index(worded, 2).postings
    assert posted.groupBy("word").count().agg(F.max("count")).first()[0] == 2
    assert "content" not in posted._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_written_without_sorting_every_word(worded, monkeypatch, tmp_path):
    from wayfolio.operators import word_index as W

    sorted_rows, real = [], W.first_per_key
    monkeypatch.setattr(W, "EARLY", 5, raising=False)
    monkeypatch.setattr(W, "first_per_key", lambda df, *rest: (sorted_rows.append(df.count()), real(df, *rest))[1])
    W.add_to_word_index(worded, str(tmp_path / "index"), "1", 2)
    assert max(sorted_rows) < W.words_of(worded).count() / 2


def test_context_reads_an_index_it_is_given(spark, worded):
    from wayfolio.operators import word_index as W

    passages = worded.withColumns({"verse_number": F.col("line_no") + 1, "title": F.lit("T"), "chapter_number": F.lit(1)})
    questions = spark.createDataFrame([("q", 1, "kindly", None, None), ("p", 1, "", None, None)], "question_id string, user_id int, message string, lat double, lng double")
    empty = {n: spark.createDataFrame([], s) for n, s in {
        "named": "name string, description string", "books": "title string, description string",
        "prayers": "id int, title string, category string, content string", "favorites": "favorite_id int, user_id int, section_id int, verse_number int",
        "places": "id int, name string, religion string, city string, country string, latitude double, longitude double, description string",
    }.items()}
    asked = lambda index: {
        r.question_id: r.context for r in build_context(
            questions, empty["named"], empty["books"], passages, empty["prayers"], empty["places"], empty["favorites"], index).collect()
    }
    whole, part = asked(None), asked(W.passing_index(worded.filter("section_id >= 55"), 8))
    assert "rare051x" in whole["q"] and "rare051x" not in part["q"] and "rare055x" in part["q"]
    # without a term: the first passages of all, the one without an id before them
    assert whole["p"] == part["p"] and whole["p"].count("\n- ") == 8 and "- kind rare001x\n" in whole["p"] and "rare000x" in whole["p"]


def test_stored_sections_nobody_expects(spark):
    from wayfolio.plans.library import load_sections, repair_sections

    schema = "book_id string, chapter_number int, section_id long, created_at int"
    existing = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 7, 3, 3), ("b", 1, 4, 4)], schema)
    passages = spark.createDataFrame([(2, 1), (2, 2), (3, 1)], "section_id long, line_no int")
    expected = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], "book_id string, chapter_number int, expected int")
    got = {r.section_id: (r.action, r.expected) for r in repair_sections(expected, existing, passages).collect()}
    assert got == {1: ("drop", 2), 2: ("keep", 2), 3: ("drop", None), 4: ("drop", 1)}
    parsed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "book_id string, chapter_number int")
    rows = load_sections(parsed, existing, passages).collect()
    assert sorted((r.book_id, r.chapter_number, r.action) for r in rows) == [("a", 1, "keep"), ("a", 2, "insert"), ("b", 1, "fill")]


def test_key_runs_cover_every_batch_once():
    from wayfolio.streaming.key_runs import cover, merged_by

    for fanout in (2, 3, 4):
        stored = set()
        for n in range(70):
            due = merged_by(n, fanout)
            if due:
                run, replaced = due
                assert set(replaced) <= stored and replaced[0][0] == run[0] and replaced[-1][1] == run[1]
                assert sum(b - a + 1 for a, b in replaced) == run[1] - run[0] + 1
                stored = stored - set(replaced) | {run}
            assert stored == set(cover(n, fanout))
            assert [b for run in cover(n, fanout) for b in range(run[0], run[1] + 1)] == list(range(n))
            assert all(sum(r[1] - r[0] + 1 == fanout**p for r in cover(n, fanout)) < fanout for p in range(7))
            stored.add((n, n))
    assert cover(16) == [(0, 15)] and cover(23) == [(0, 15), (16, 19), (20, 20), (21, 21), (22, 22)]


def test_key_runs_hold_what_was_added_and_survive_replays(spark, tmp_path):
    from wayfolio.streaming.key_runs import KeyRuns, cover

    runs, added = KeyRuns(spark, str(tmp_path / "keys"), buckets=3, fanout=2), []

    def frame(keys):
        return spark.createDataFrame([(k,) for k in keys], "_key string").coalesce(1)

    asked = frame([f"k{i}" for i in range(12)] + ["", "k0 "])
    for batch in range(6):
        own = [] if batch == 3 else [f"k{2 * batch}", f"other {batch}"]  # a batch without keys leaves an empty run
        for _ in range(2 if batch in (2, 4, 5) else 1):  # a batch that broke and runs again, after a merge as well
            runs.compact(batch)
            held = runs.held(asked, batch)
            assert sorted(r._key for r in held.collect()) == sorted(added) if held is not None else batch == 0
            runs.add(frame(own), batch)
        added += [k for k in own if k.startswith("k")]
    runs.compact(6)
    runs.compact(7)
    left = {p.name for p in (tmp_path / "keys").iterdir() if p.name.startswith("run=")}
    assert {f"run={a}-{b}" for a, b in cover(6, 2)} <= left
    assert not left & {"run=0-0", "run=1-1", "run=2-2", "run=3-3", "run=0-1"}
    held = runs.held(frame(["k4"]), 6)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and re.search(r"PartitionFilters: \[[^\]]*bucket", plan), plan
    assert len({f.split("/run=")[1].split("/")[0] for f in held.inputFiles()}) == len(cover(6, 2))


def test_landed_pages_share_files(spark, tmp_path):
    html = ["<p>a</p>\r\n", None, "", "x\u0003", "\u0003\u001b1 \u001b0\u001b\n\ny", "é\n"] + [f"page {i}" for i in range(2000)]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    files = _landed_pages(Tables(spark, str(tmp_path)))
    assert {r.page_id: r.html for r in _pages_of(files).collect()} == dict(enumerate(html))
    assert files.count() <= len(html) // FILE_PAGES + spark.sparkContext.defaultParallelism


def test_batches_of_one_file_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    source = spark.readStream.schema("id long").parquet(f"{tmp_path}/one")
    seen = []

    def take(batch, batch_id):
        per_task = batch.groupBy(F.spark_partition_id()).count().collect()
        seen.append((len(per_task), sum(r["count"] for r in per_task)))

    balanced_stream(source, "id").writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert len(seen) == 1 and seen[0][0] > 1 and seen[0][1] == 100
