"""Operators against brute force, and the plans they must have."""

import re
import random

import pytest
from pyspark.sql import functions as F

from wayfolio.functions.places import location_key
from wayfolio.operators import merge as M
from wayfolio.operators.dedupe import dedupe_incoming, insert_ignore
from wayfolio.operators.geo import _spread, nearest_each, places_around, radius_pairs
from wayfolio.operators.ordered import first_per_key, neighbors, ranged, row_numbers

RNG = random.Random(5)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ordered --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 40}"
        rows.append((None if i % 50 == 0 else key, RNG.choice((None, *range(400))), i))
    return spark.createDataFrame(rows, "k string, o int, id int").cache()


def expected_numbers(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append((r.o is None, r.o or 0, r.id))
    return {k: [x[2] for x in sorted(v)] for k, v in groups.items()}


@pytest.mark.parametrize("chunk", [None, 1, 37])
def test_row_numbers(skewed, chunk):
    got = {r.id: r.n for r in row_numbers(skewed, ["k"], ["o", "id"], "n", chunk).collect()}
    want = {i: n for ids in expected_numbers(skewed).values() for n, i in enumerate(ids, 1)}
    assert got == want


@pytest.mark.parametrize("chunk", [None, 1, 37])
def test_neighbors(skewed, chunk):
    out = neighbors(skewed, ["k"], ["o", "id"], {"p": "id"}, {"n": "id"}, chunk).collect()
    got = {r.id: (r.p, r.n) for r in out}
    want = {}
    for ids in expected_numbers(skewed).values():
        for j, i in enumerate(ids):
            want[i] = (ids[j - 1] if j else None, ids[j + 1] if j + 1 < len(ids) else None)
    assert got == want


def test_crowded_and_equal_order_values(spark):
    """Half of a group at one value, the rest crowded at one end of a wide range."""
    rows = [("hot", 500 if i % 2 else (i % 40 if i % 10 else 10 ** 9), i) for i in range(2000)] + [("tied", 1, i) for i in range(2000, 2300)]
    df = spark.createDataFrame(rows, "k string, o long, id int")
    cut = ranged(df, ["k"], ["o", "id"], 20)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 300
    got = {r.id: r.n for r in row_numbers(df, ["k"], ["o", "id"], "n", 20).collect()}
    assert got == {i: n for ids in expected_numbers(df).values() for n, i in enumerate(ids, 1)}
    out = {r.id: (r.p, r.q) for r in neighbors(df, ["k"], ["o", "id"], {"p": "id"}, {"q": "id"}, 20).collect()}
    for ids in expected_numbers(df).values():
        assert [out[i][0] for i in ids] == [None, *ids[:-1]] and [out[i][1] for i in ids] == [*ids[1:], None]


def test_keys_with_one_beginning_and_equal_rows_are_spread(spark):
    df = spark.range(4000).select(F.concat(F.lit("https://example.org/documents/"), F.format_string("%05d", "id")).alias("url"), F.lit("hot").alias("k"))
    assert max(r["count"] for r in ranged(df, ["k"], ["url"], 10).groupBy("_part").count().collect()) <= 800
    ties = spark.range(4000).select(F.lit(1).alias("k"), F.lit("same").alias("o"), F.col("id").alias("v"))
    assert max(r["count"] for r in ranged(ties, ["k"], ["o"], 10).groupBy("_part").count().collect()) <= 800
    assert sorted(r.n for r in row_numbers(ties, ["k"], ["o"], "n", 10).collect()) == list(range(1, 4001))


@pytest.mark.parametrize("n", [1, 1000, 1001])
def test_first_per_key_cuts_before_the_last_shuffle(spark, n):
    df = spark.range(5000).select(F.pmod("id", F.lit(2)).alias("k"), F.col("id").alias("v"))
    out = first_per_key(df, ["k"], ["v"], n)
    assert sorted(r.v for r in out.collect()) == list(range(2 * n))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Above the engine's limit no window may run over the rows of a key: only over one row per key and range.
    windows = re.findall(r"Window \[[^\]]*", plan)
    assert ("WindowGroupLimit" in plan) if n <= 1000 else windows and all("sum(_n" in w for w in windows), plan


@pytest.mark.parametrize("n", [2, 1500])
def test_first_per_key_orders_nulls_and_ties_alike_at_every_size(spark, n):
    rows = [("hot", None if i % 50 == 0 else i // 2, i) for i in range(4000)] + [("cold", 1, 4000), (None, 2, 4001), (None, None, 4002)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(5)
    want = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2])):
        want.setdefault(row[0], []).append(row[2])
    got = {}
    for r in first_per_key(df, ["k"], ["o", F.desc("id")], n, rank="place").orderBy("place").collect():
        got.setdefault(r.k, []).append(r.id)
    assert got == {k: ids[:n] for k, ids in want.items()}
    assert first_per_key(df.limit(0), ["k"], ["o"], n).count() == 0


def test_row_numbers_by_text_and_time(spark):
    df = spark.createDataFrame([(f"t{i * 37 % 101:03d}x", i) for i in range(101)], "s string, id int").withColumn("k", F.lit(1))
    df = df.withColumn("ts", F.timestamp_seconds(F.col("id") * 1000)).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id")))
    for order in ("s", "ts", "d"):
        rows = row_numbers(df, ["k"], [order], "n", 10).orderBy("n").collect()
        values = [r[order] for r in rows]
        assert values == sorted(values) and [r.n for r in rows] == list(range(1, 102))


def test_first_per_key_is_cut_before_the_shuffle(skewed):
    plan = plan_of(first_per_key(skewed, ["k"], ["id"], 3))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


# --- deduplication --------------------------------------------------------------------


def greedy(rows, existing, names):
    claimed = {(n, r[n]) for r in existing for n in names if r[n] is not None}
    known, out = set(claimed), {}
    for r in sorted(rows, key=lambda r: r["arrival"]):
        mine = {(n, r[n]) for n in names if r[n] is not None}
        if mine & known:
            out[r["arrival"]] = "duplicate_existing"
        elif mine & claimed:
            out[r["arrival"]] = "duplicate_batch"
        else:
            out[r["arrival"]] = "accepted"
            claimed |= mine
    return out


@pytest.mark.parametrize("width,hot", [(6, 0.0), (40, 0.34), (400, 0.0)])
def test_dedupe_equals_the_sequential_rule(spark, width, hot):
    def row(i):
        pick = lambda: None if RNG.random() < 0.2 else ("hot" if RNG.random() < hot else str(RNG.randrange(width)))
        return {"arrival": i, "a": pick(), "b": pick(), "c": pick()}

    rows = [row(i) for i in RNG.sample(range(10_000), 500)]
    stored = [row(i) for i in range(20_000, 20_010)]
    schema = "arrival long, a string, b string, c string"
    keys = {n: F.col(n) for n in "abc"}
    out = dedupe_incoming(spark.createDataFrame(rows, schema), spark.createDataFrame(stored, schema), keys)
    assert {r.arrival: r.outcome for r in out.collect()} == greedy(rows, stored, "abc")


def test_dedupe_chain_and_rerun(spark):
    rows = [(1, "k1", None), (2, "k1", "k2"), (3, None, "k2"), (4, None, None), (5, None, None)]
    new = spark.createDataFrame(rows, "arrival long, a string, b string")
    keys = {"a": F.col("a"), "b": F.col("b")}
    out = dedupe_incoming(new, None, keys)
    assert {r.arrival: r.outcome for r in out.collect()} == {1: "accepted", 2: "duplicate_batch", 3: "accepted", 4: "accepted", 5: "accepted"}
    again = dedupe_incoming(new.filter("a is not null or b is not null"), out.filter("outcome = 'accepted'"), keys)
    assert again.filter("outcome = 'accepted'").count() == 0


def test_dedupe_output_shares_no_key_with_the_store(tables):
    keys = {"location": location_key()}
    taken = dedupe_incoming(tables("places_incoming"), tables("places_existing"), keys).filter("outcome = 'accepted'")
    both = taken.select(location_key().alias("k")).dropna().join(tables("places_existing").select(location_key().alias("k")), "k")
    assert both.isEmpty()


def test_insert_ignore(spark):
    new = spark.createDataFrame([(1, "A", None), (2, "a", None), (3, "B", "c"), (4, "b", "C"), (5, "D", "e")], "arrival long, name string, city string")
    old = spark.createDataFrame([("D", "e"), ("A", None)], "name string, city string")
    assert [r.arrival for r in insert_ignore(new, old, ["name", "city"]).orderBy("arrival").collect()] == [1, 3]


# --- distance -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def globe(spark):
    points = [(RNG.uniform(-90, 90), RNG.uniform(-180, 180)) for _ in range(300)]
    points += [(RNG.uniform(88, 90), RNG.uniform(-180, 180)) for _ in range(40)]
    points += [(RNG.uniform(-5, 5), RNG.choice((-1, 1)) * RNG.uniform(179, 180)) for _ in range(40)]
    points += [(10 + RNG.uniform(-0.01, 0.01), 20 + RNG.uniform(-0.01, 0.01)) for _ in range(60)]
    points += [(0.0, 0.0)] * 30 + [(90.0, 10.0), (-90.0, -170.0), (0.0, 180.0), (0.0, -180.0)]
    rows = [(i, la, lo) for i, (la, lo) in enumerate(points)]
    return spark.createDataFrame(rows, "id int, latitude double, longitude double").cache()


@pytest.fixture(scope="module")
def spots(spark):
    rows = [(0, 89.9, 0.0), (1, 0.0, 179.99), (2, 0.0, -179.99), (3, 10.0, 20.0), (4, -90.0, 5.0), (5, 45.0, -100.0), (6, 0.0, 0.0), (7, None, 1.0)]
    return spark.createDataFrame(rows, "target_id int, lat double, lng double")


def brute(globe, spots):
    from wayfolio.functions.places import haversine_km

    pairs = spots.crossJoin(globe).withColumn("d", haversine_km(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude")))
    return [(r.target_id, r.id, r.d) for r in pairs.filter("d is not null").collect()]


@pytest.mark.parametrize("km", [0.25, 25.0, 250.0, 2000.0, 9000.0, 20038.0])
def test_radius_pairs(globe, spots, km):
    df = radius_pairs(spots, globe, km, "lat", "lng", "latitude", "longitude")
    got = sorted((r.target_id, r.id) for r in df.collect())
    assert got == sorted((t, i) for t, i, d in brute(globe, spots) if d <= km)
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_places_around_keeps_the_cap(globe, spots):
    out = places_around(spots, globe, 2000.0, 5)
    near = {}
    for t, i, d in brute(globe, spots):
        if d <= 2000:
            near.setdefault(t, []).append(i)
    want = sorted((t, i) for t, ids in near.items() for i in sorted(ids)[:5])
    assert sorted((r.target_id, r.id) for r in out.collect()) == want


@pytest.mark.parametrize("enough", [16, 1])
def test_nearest_each(globe, spots, enough):
    out = nearest_each(spots, globe, 4, "target_id", enough=enough)
    want = []
    pairs = brute(globe, spots)
    for t in range(7):
        ranked = sorted((round(d, 6), i) for t2, i, d in pairs if t2 == t)[:4]
        want += [(t, i, n) for n, (_, i) in enumerate(ranked, 1)]
    assert sorted((r.target_id, r.id, r.nearest_rank) for r in out.collect()) == sorted(want)


def test_nearest_each_of_points_far_from_a_cluster(spark):
    cluster = [(i, 40 + RNG.uniform(-3, 3), 20 + RNG.uniform(-3, 3)) for i in range(4000)] + [(9000 + i, 40.0, 20.0) for i in range(50)]
    places = spark.createDataFrame(cluster, "id int, latitude double, longitude double")
    far = spark.createDataFrame([(i, -60.0 + i, -100.0 + 9 * i) for i in range(10)] + [(50, 90.0, 0.0), (51, 40.0, 20.0)], "target_id int, lat double, lng double")
    out = nearest_each(far, places, 5, "target_id")
    want = []
    pairs = brute(places, far)
    for t in {t for t, _, _ in pairs}:
        ranked = sorted((round(d, 6), i) for t2, i, d in pairs if t2 == t)[:5]
        want += [(t, i, n) for n, (_, i) in enumerate(ranked, 1)]
    assert sorted((r.target_id, r.id, r.nearest_rank) for r in out.collect()) == sorted(want)


def test_circles_at_the_poles_touch_few_cells(spark):
    poles = spark.createDataFrame([(90.0, 10.0), (-90.0, 0.0), (89.999, 5.0), (60.0, 179.9999), (0.0, 0.0)], "lat double, lng double")
    assert max(r["count"] for r in _spread(poles, 0.25, "lat", "lng").groupBy("lat").count().collect()) < 100


@pytest.mark.parametrize("crowd", [5000, 40, 5])
def test_first_around_in_a_dense_place(spark, crowd):
    points = [(i, 10 + RNG.uniform(-0.004, 0.004), 20 + RNG.uniform(-0.004, 0.004)) for i in RNG.sample(range(9000), 1500)]
    right = spark.createDataFrame(points, "id int, latitude double, longitude double")
    seeds = [(i, 10 + RNG.uniform(-0.006, 0.006), 20 + RNG.uniform(-0.006, 0.006)) for i in range(40)] + [(99, 50.0, 50.0)]
    left = spark.createDataFrame(seeds, "target_id int, lat double, lng double")
    out = places_around(left, right, 0.25, 5, crowd=crowd)
    near = {}
    for t, i, d in brute(right, left):
        if d <= 0.25:
            near.setdefault(t, []).append(i)
    want = sorted((t, i) for t, ids in near.items() for i in sorted(ids)[:5])
    assert sorted((r.target_id, r.id) for r in out.collect()) == want


def test_pages(spark):
    from wayfolio.plans.explore import page

    df = spark.range(1003).repartition(7).withColumn("v", (F.col("id") * 37) % 101)
    ordered = [r.id for r in df.orderBy("v", "id").collect()]
    order = [F.asc("v"), F.asc("id")]
    for number in (1, 5, 41, 42, 99):
        start = (min(number, 42) - 1) * 24
        for shallow in (100_000, 0):
            assert [r.id for r in page(df, order, number, 24, shallow).collect()] == ordered[start:start + 24]


def test_lookup_spreads_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b")], "id int, k string")
    values = spark.createDataFrame([("a", 10)], "k string, v int")
    assert sorted(tuple(r) for r in M.left_lookup(df, values, "k").select("id", "k", "v").collect()) == [
        (1, "a", 10), (2, None, None), (3, "", None), (4, "b", None),
    ]


# --- merges ---------------------------------------------------------------------------


def test_merge_never_overwrites(spark):
    schema = "id long, name string, city string, image_url string, latitude double, longitude double, arrival long"
    old = spark.createDataFrame([(1, "A", "x", "", 1.0, 1.0, 1), (2, "A", "y", None, 1.0, 1.0, 2), (3, "B", "z", "i", 2.0, 2.0, 3), (4, "N", "q", None, None, None, 4)], schema)
    new = spark.createDataFrame([(9, "a ", "new", "img1", 1.0, 1.0, 9), (10, "A", "new", "img2", 1.0, 1.0, 10), (11, "B", "no", "no", 2.0, 2.0, 11),
                                 (12, "C", "", None, 3.0, 3.0, 12), (13, "C", "late", "pic", 3.0, 3.0, 13), (14, "Z", "z", None, None, 3.0, 14)], schema)
    from wayfolio.plans.ingest import one_key

    out = M.merge_fill_missing(old, new, one_key(), ("city", "image_url"))
    rows = {r.id: (r.city, r.image_url, r.action) for r in out.collect()}
    assert rows == {1: ("x", "", "kept"), 2: ("y", "img1", "updated"), 3: ("z", "i", "kept"), 4: ("q", None, "kept"), 12: ("late", "pic", "inserted")}
    again = M.merge_fill_missing(out.drop("action"), new, one_key(), ("city", "image_url"))
    assert {r.id: (r.city, r.image_url) for r in again.collect()} == {i: v[:2] for i, v in rows.items()}


def test_backfill_is_idempotent(tables):
    once = M.backfill_defaults(tables("places").select("id", "city", "image_url"), {"city": "Unknown", "image_url": "none"})
    twice = M.backfill_defaults(once, {"city": "other", "image_url": "other"})
    assert once.exceptAll(twice).isEmpty() and once.filter("trim(city) = ''").isEmpty()


def test_toggle_twice_gives_back_the_members(tables):
    members = tables("favorites").select("user_id", "section_id").distinct()
    changes = members.limit(20)
    assert M.toggle(M.toggle(members, changes, ["user_id", "section_id"]), changes, ["user_id", "section_id"]).exceptAll(members).isEmpty()


# --- plans ----------------------------------------------------------------------------


def test_top_k_and_pruning(tables):
    from wayfolio.plans.audit import by_quality

    plan = plan_of(by_quality(tables("places")))
    assert "TakeOrderedAndProject" in plan
    scan = plan_of(tables("orders").filter("o_orderkey = 5").select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in scan


def test_text_rules_do_not_shuffle(tables):
    from wayfolio.plans.corpus import PROFILES, segment_corpus

    docs = tables("documents").select("doc_id", "text")
    for profile in PROFILES.values():
        if profile.method != "json":
            assert "Exchange" not in plan_of(segment_corpus(docs, profile)), profile.name


def sequential(rows):
    """rows: (arrival, {kind: key}); the rule, row by row."""
    claimed, out = set(), {}
    for arrival, keys in sorted(rows):
        own = {k for k in keys if k is not None}
        out[arrival] = "duplicate_batch" if own & claimed else "accepted"
        if out[arrival] == "accepted":
            claimed |= own
    return out


def deduped(spark, rows, monkeypatch):
    """The outcome by arrival, and how many tables were stored."""
    from wayfolio.operators import dedupe

    stored, given = [], dedupe.materialize
    monkeypatch.setattr(dedupe, "materialize", lambda df: stored.append(1) or given(df))
    df = spark.createDataFrame([(a, *keys) for a, keys in rows], "arrival long, a string, b string")
    got = dedupe.dedupe_incoming(df, None, {"a": F.concat(F.lit("a"), "a"), "b": F.concat(F.lit("b"), "b")}).select("arrival", "outcome").collect()
    return {r.arrival: r.outcome for r in got}, len(stored)


def plain_keys(rows):
    return [(a, [f"a{x}" if x is not None else None, f"b{y}" if y is not None else None]) for a, (x, y) in rows]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Row i shares one key with row i - 1 and one with row i + 1."""
    n = 10_000
    rows = [(i, (str(i // 2), str((i + 1) // 2))) for i in range(n)]
    got, stored = deduped(spark, rows, monkeypatch)
    assert got == sequential(plain_keys(rows))
    assert stored <= 25


def test_chains_in_any_order(spark, monkeypatch):
    import random

    draw = random.Random(8)
    place = list(range(600))
    draw.shuffle(place)
    rows = [(place[i], (str(i // 2), str((i + 1) // 2))) for i in range(600)]
    rows += [(1000 + i, (draw.choice([None, *"cdefgh"]), f"x{draw.randrange(200)}")) for i in range(300)]
    got, _ = deduped(spark, rows, monkeypatch)
    assert got == sequential(plain_keys(rows))


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    from wayfolio.operators import dedupe

    monkeypatch.setattr(dedupe, "GROUP_PAIRS", 10)
    rows = [(i, (str(i // 2), str((i + 1) // 2))) for i in range(18)] + [(100 + i, (f"s{i // 2}", f"s{(i + 1) // 2}")) for i in range(4)]
    got, _ = deduped(spark, rows, monkeypatch)
    assert got == sequential(plain_keys(rows))


# --- spatial layout -------------------------------------------------------------------

CIRCLES = [(10.0, 20.0, 500.0), (-12.0, 179.5, 900.0), (3.0, -179.99, 250.0), (89.0, 10.0, 400.0), (-84.0, 100.0, 2500.0), (0.0, 0.0, 25000.0), (45.0, 540.0, 700.0), (51.5, 0.1, 0.5)]


@pytest.fixture(scope="module")
def globe(spark):
    rows = [(i, RNG.uniform(-90, 90), RNG.uniform(-180, 180)) for i in range(3000)]
    for n, (lat, lng, km) in enumerate(CIRCLES):  # near each circle's border as well
        rows += [(10000 + 100 * n + i, max(-90.0, min(90.0, lat + RNG.uniform(-1.2, 1.2) * km / 111)), (lng + RNG.uniform(-3, 3) * km / 111 + 180) % 360 - 180) for i in range(100)]
    rows += [(20000 + i, lat, lng) for i, (lat, lng) in enumerate(
        [(None, 1.0), (1.0, None), (None, None), (10.0, 380.0), (-12.0, -180.0), (-12.0, 180.0), (90.0, 0.0), (-90.0, 77.0), (10.0, float("nan")), (45.0, 180.0)]
    )]
    rows += [(30000 + i, 10.0, 20.0) for i in range(1500)]  # a third at one position
    return spark.createDataFrame(rows, "id int, latitude double, longitude double").cache()


def test_stored_places_equal_all_places(spark, globe, tmp_path):
    from wayfolio.functions.places import haversine_km
    from wayfolio.operators.filters import within_km
    from wayfolio.operators.spatial import RANGES, key_ranges, read_places, stored_near, write_places
    from wayfolio.plans.explore import explore

    path = str(tmp_path / "placed")
    write_places(globe, path, 12)
    stored = read_places(spark, path)
    assert stored.count() == globe.count()
    for lat, lng, km in CIRCLES:
        want = sorted(r.id for r in globe.filter(haversine_km(lat, lng, F.col("latitude"), F.col("longitude")) <= km).collect())
        assert sorted(r.id for r in within_km(globe, lat, lng, km).collect()) == want
        near = stored_near(stored, lat, lng, km)
        assert near.columns == globe.columns and sorted(r.id for r in within_km(near, lat, lng, km).collect()) == want
        ranges = key_ranges(lat, lng, km)
        assert len(ranges) <= RANGES and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    empty = [c for c in ("name", "religion", "denomination", "country", "city", "address", "description", "image_url", "website_url")]
    full = globe.select("*", *[F.lit("x").alias(c) for c in empty])
    for lat, lng, km in CIRCLES[:5]:
        want = sorted(r.id for r in globe.filter(F.round(haversine_km(lat, lng, F.col("latitude"), F.col("longitude")), 6) <= km).collect())
        assert sorted(r.id for r in explore(full, location=(lat, lng), radius_km=km).collect()) == want


def test_stored_places_are_pruned_in_the_plan(spark, globe, tmp_path):
    from wayfolio.operators.spatial import key_ranges, read_places, stored_near, write_places

    path = str(tmp_path / "placed")
    write_places(globe, path, 12)
    near = stored_near(read_places(spark, path), -12.0, 179.5, 900.0)
    plan = plan_of(near)
    assert re.search(r"PartitionFilters: \[region#\d+ IN ", plan) and "PushedFilters: [Or(" in plan
    regions = {int(f) for f in re.search(r"region#\d+ IN \(([-\d,]+)\)", plan).group(1).split(",")}
    assert 2 <= len(regions) <= 8
    sizes = [r["count"] for r in read_places(spark, path).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 900  # the crowded position is parted as well
    covered = sum(high - low + 1 for low, high in key_ranges(51.5, 0.1, 0.5))
    assert covered < 2 ** 32 / 10_000
    write_places(globe.limit(0), str(tmp_path / "none"))
    assert stored_near(read_places(spark, str(tmp_path / "none"), globe.schema), 1.0, 2.0, 3.0).count() == 0


def test_one_large_row_group_is_spread(spark, tmp_path):
    from wayfolio.session import balanced

    # many splits by bytes, all rows in one row group
    spark.range(200_000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(1).write.parquet(f"{tmp_path}/one")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        scan = spark.read.parquet(f"{tmp_path}/one")
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        rows = balanced(scan, "id").groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) > 1 and sum(r["count"] for r in rows) == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
