"""Exact dedup, licences, decontamination, mixing and sharding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wayfolio.llm import decontamination, exact_dedup, licenses, mixing, sharding
from wayfolio.llm.common import table
from samples import index_words, lowered, messy, messy_rows, nothing, sentence, space_words  # noqa: F401


@pytest.mark.parametrize("cells", [exact_dedup.MAX_CELLS, 256])
def test_exact_dedup(messy, cells):
    groups = defaultdict(list)
    for doc_id, text, *_ in messy_rows():
        groups[hashlib.sha256(lowered(text).encode()).hexdigest()].append(doc_id)
    got = exact_dedup.exact_dedup(messy, max_cells=cells).collect()  # few cells: several segments
    assert sorted((r.doc_id or -1, r.text_sha256) for r in got) == sorted((d or -1, s) for s, ids in groups.items() for d in ids)
    for sha, ids in groups.items():
        own = [r for r in got if r.text_sha256 == sha]
        assert {(r.keep_id, r.group_size) for r in own} == {(max((i for i in ids if i is not None), default=None), len(ids))}
        assert [r.doc_id for r in own if r.kept] == [own[0].keep_id]


def test_unique_rows_are_not_shuffled(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = exact_dedup.exact_dedup(rows)
    assert got.filter("kept").count() == 500
    union = got._jdf.queryExecution().executedPlan().toString()
    assert union.count("Exchange hashpartitioning") <= 2  # both sides of the suspects' join, none over the rest


def test_license_scan_finds_whole_and_edited_notices(spark):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "gratis").replace("without limitation", "without any limit")
    rows = [
        (1, sentence("a", 300) + " " + mit + " " + sentence("b", 300)), (2, sentence("c", 55) + "\n" + edited), (3, sentence("d", 400)),
        (4, None), (5, ""), (6, "Released under the MIT License."), (7, " ".join(mit.split()[:30])), (7, "RELEASED UNDER THE MIT LICENSE"),
        (8, sentence("e", 31) + " licensed under CC BY-NC 4.0 " + sentence("f", 33)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(docs).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (6, "MIT notice"), (7, "MIT notice"), (8, "CC-BY-NC-4.0 notice")}
    assert got[1, "MIT"].first_word == 300 and got[1, "MIT"].containment == 1
    assert 0.8 <= got[2, "MIT"].containment < 1
    assert licenses.license_scan(docs, {"none": "too short"}).count() == 0
    assert licenses.license_scan(docs, {}).count() == 0


def plain_licences(rows, templates):
    out = []
    shingles = lambda words: [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    for doc_id, text in rows:
        own = shingles(index_words(text))
        for name, notice in templates.items():
            wanted = set(shingles(index_words(notice)))
            if not wanted:
                continue
            span = 1 << (len(wanted) - 1).bit_length()
            found = []
            for begin in range(-span, len(own), span):
                held = [(i, own[i]) for i in range(max(0, begin), min(len(own), begin + 2 * span)) if own[i] in wanted]
                if len({h for _, h in held}) >= 0.8 * len(wanted):
                    found.append((len({h for _, h in held}), held[0][0], held[-1][0]))
            if found:
                out.append((doc_id, name, len(wanted), max(f[0] for f in found), min(f[1] for f in found), max(f[2] for f in found) + 4))
    return sorted(out, key=repr)


def test_license_scan_equals_a_plain_one(spark, messy, nothing):
    bsd, gpl, isc = (licenses.TEMPLATES[k].split() for k in ("BSD conditions", "GPL-3.0 header", "ISC"))
    cut = lambda words, *gone: " ".join(w for i, w in enumerate(words) if i not in gone)
    rows = [(500 + k, sentence(("pad", k), 40 + k).rsplit(" ", 40)[0] + " " + cut(isc, *range(0, k, 5))) for k in range(1, 20)]
    rows += [(600, cut(bsd)), (600, cut(bsd)), (None, cut(bsd, 9)), (601, cut(bsd, 9, 24, 40)), (602, cut(bsd) + " x " + cut(gpl, 30)),
             (603, " ".join([cut(isc)] * 40)), (604, sentence("far", 20_000) + " " + cut(gpl)), (605, "b" * 2_000_000 + " " + cut(isc))]
    docs = messy.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    got = licenses.license_scan(docs).collect()
    want = plain_licences([(d, t) for d, t, *_ in messy_rows()] + rows, licenses.TEMPLATES)
    assert sorted(((r.doc_id, r.license, r.n_shingles, r.matched, r.first_word, r.last_word) for r in got), key=repr) == want
    assert len(want) > 10 and all(r.containment == r.matched / r.n_shingles for r in got)
    assert licenses.license_scan(nothing).count() == 0


def plain_hits(docs, items, window=10):
    windows = defaultdict(set)
    for item_id, text in items:
        words = index_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i:i + n])].add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, found = index_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[i:i + n])):
                    found |= ids
                    hit |= set(range(i, i + n))
        names = ",".join(sorted(str(i) for i in found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [decontamination.BROADCAST_ROWS, 0])
def test_contamination(spark, most):
    words = sentence("item", 30).split()
    items = [(1, " ".join(words)), (2, "the3"), (3, None), (4, ""), (5, "of in the one two three four five"), (1, sentence("other", 14)),
             (6, "Ab Ab Ab Ab Ab Ab Ab Ab Ab Ab Ab"), (7, " ".join(words[:12]))]
    docs = [
        (1, "x " + " ".join(words[3:17]).upper() + " y the3"), (2, " ".join(words[:9])), (3, None), (4, "..."), (5, "ab " * 25),
        (6, sentence("far", 3000) + " " + " ".join(words)), (6, "the3 the3"), (None, " ".join(words)), (7, "of in the, one-two three four five!"),
        (8, " ".join(words[10:20]) + " gap " + " ".join(words[10:20])),
    ]
    docs += [(50 + i, f"{i} " + " ".join(words) + f" {i}") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit(1)).withColumn("pos", F.lit(2))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(d, i, most=most).drop("mark").collect()
    assert sorted(map(tuple, got), key=repr) == plain_hits(docs, items)
    assert decontamination.contamination(d.filter("false"), i).count() == 0
    assert not decontamination.contamination(d, i.filter("false")).filter("contaminated").count()
    clean = decontamination.clean_documents(d, i)
    assert clean.columns == d.columns
    bad = [r for r in plain_hits(docs, items) if r[-1]]
    assert clean.count() == len(docs) - len(bad)


def test_contamination_on_messy_rows(spark, messy, nothing):
    long = sentence("long", 5000).split()
    items = [(1, sentence("base", 120)), (1, sentence("base", 120)), (2, "word"), (3, " ".join(long[4000:4012])), (4, None), (5, "a" * 3000)]
    benchmark = spark.createDataFrame([(*i, 0, "x") for i in items], "item_id bigint, text string, n int, row string")
    got = decontamination.contamination(messy, benchmark).drop("mark").collect()
    assert sorted(map(tuple, got), key=repr) == plain_hits([(d, t) for d, t, *_ in messy_rows()], items)
    assert decontamination.clean_documents(nothing, benchmark).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "beta x x alpha x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "alpha beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id bigint, text string")
    terms, vocabulary = decontamination.test_items(items)
    index = decontamination.postings(docs, vocabulary)
    ids = {r.row: r.doc_id for r in index.filter("is_end").collect()}
    got = {(ids[r.row], r.item_id) for r in decontamination.proximity_matches(terms, index, 5).collect()}
    assert got == {(1, 9)}


def test_mix_targets_and_cuts(messy):
    rows = messy_rows()
    got = mixing.mix(messy, ["doc_id", "source"]).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len(space_words(t))) for d, t, *_ in rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(space_words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for source in order:
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sizes[source] and own[0].target == pytest.approx(target[source])
        assert sum(r.taken for r in own) == int(own[0].target + 1e-9)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = mixing.mix(messy.repartition(3), ["doc_id"]).select("doc.doc_id", "size", "taken").collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mixed_documents_have_the_taken_words(messy, nothing):
    plan = mixing.mix(messy, ["source"]).groupBy("doc.source").agg(F.sum("taken").alias("w")).collect()
    out = mixing.mixed_documents(messy)
    assert out.dtypes == messy.dtypes
    words = Counter()
    for r in out.select("source", "text", "n_chars").collect():
        assert r.n_chars == len(r.text)
        words[r.source] += len(space_words(r.text))
    assert {r.source: r.w for r in plan if r.w} == dict(words)
    assert mixing.mixed_documents(nothing).count() == 0


def test_kd_shards(messy, nothing):
    got = sharding.kd_shards(messy, leaves=4).collect()
    rows = messy_rows()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for shard in range(4):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.kd_shards(nothing, leaves=4).count() == 0
    out = sharding.sharded_documents(messy, leaves=4)
    assert out.columns == [c for c in messy.columns if c != "shard"] + ["shard"] and out.count() == len(rows)


def test_kd_shards_are_even(spark):
    docs = table(spark, SMALL, "documents").select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "*")
    docs = docs.withColumn("text", F.concat("k", F.substring("text", 1, 700))).withColumn("doc_id", F.col("doc_id") * 20 + F.col("k"))
    sizes = sharding.kd_shards(docs, leaves=7).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    share = sum(r.b for r in sizes) / 7
    assert len(sizes) == 7 and all(abs(r.b - share) < 0.02 * share for r in sizes)
    by_target = sharding.kd_shards(docs, target_bytes=int(share)).select("shard").distinct().count()
    assert by_target in (7, 8)


def plain_tree(points, leaves, base, first=0):
    """Shard of each point (at, size), by recursion."""
    if leaves == 1 or not points:
        return {p: first for p in points}
    spread = [(max(p[1][d] for p in points) - min(p[1][d] for p in points)) / b for d, b in enumerate(base)]
    dim, more = spread.index(max(spread)), -(-leaves // 2)
    wanted, before = sum(p[2] for p in points) * more / leaves, 0
    for value in sorted({p[1][dim] for p in points}):
        own = sum(p[2] for p in points if p[1][dim] == value)
        if before + own >= wanted:
            break
        before += own
    cut = value + 1 if wanted - before > before + own - wanted else value
    left, right = [p for p in points if p[1][dim] < cut], [p for p in points if p[1][dim] >= cut]
    return plain_tree(left, more, base, first) | plain_tree(right, leaves // 2, base, first + more)


@pytest.mark.parametrize("task_rows, leaves", [(50_000, 40), (90, 40), (1, 7), (1, 1)])
def test_tree_equals_a_plain_one(spark, monkeypatch, task_rows, leaves):
    monkeypatch.setattr(sharding, "TASK_ROWS", task_rows)
    monkeypatch.setattr(sharding, "SLACK", 0)
    # every third point repeats, every fifth shares a coordinate, one weighs as much as many
    given = [(i, ((i % 3 and i * 7919) % 10_007, 5 if i % 5 == 0 else i * 104_729 % 1_000_003), 900 if i == 17 else 1 + i % 13) for i in range(300)]
    points = spark.createDataFrame([(i, s, list(at)) for i, at, s in given], "doc_id bigint, size bigint, at array<bigint>").repartition(4)
    got = {r.doc_id: r.shard for r in sharding.grow_tree(points, 2, leaves).collect()}
    base = [max(p[1][d] for p in given) - min(p[1][d] for p in given) for d in (0, 1)]
    assert got == {p[0]: s for p, s in plain_tree(given, leaves, base).items()}


def test_equal_points_and_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 10)
    same = spark.range(50).select("id", F.lit(3).cast("long").alias("size"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("at"))
    assert [r[0] for r in sharding.grow_tree(same, 2, 9).groupBy("shard").count().select("count").collect()] == [50]
    monkeypatch.setattr(sharding, "TASK_ROWS", 50_000)
    many = spark.range(200_000).select("id", F.lit(1).cast("long").alias("size"), F.array(
        F.pmod(F.xxhash64("id"), F.lit(1 << 61)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 61))).alias("at"))
    sizes = sharding.grow_tree(many, 2, 100_000).groupBy("shard").count().agg(F.count("*"), F.max("count"), F.min("shard"), F.max("shard")).first()
    assert sizes[0] > 98_000 and sizes[1] <= 4 and (sizes[2], sizes[3]) == (0, 99_999)


def test_searches_read_few_rows(spark, monkeypatch):
    """The bins of a level tell where its medians are; rows are searched in the median's bin alone, not in the whole node."""
    rng = random.Random(11)
    rows = [(i, rng.randrange(16, 90), [rng.randrange(1 << 40), rng.randrange(6) << 30 | rng.randrange(1 << 20)]) for i in range(6000)]
    points = spark.createDataFrame(rows, "doc_id long, size long, at array<long>").cache()
    searched, narrow = [], sharding._narrow

    def counted(own, searches):
        opened = searches.filter("cut IS NULL").select("first", "dim", "lo", "hi")
        searched.append(own.join(opened, "first").filter("element_at(at, dim + 1) >= lo AND element_at(at, dim + 1) < hi").count())
        return narrow(own, searches)

    monkeypatch.setattr(sharding, "_narrow", counted)
    monkeypatch.setattr(sharding, "TASK_ROWS", 500)
    grown = sharding.grow_tree(points, 2, 32)
    sizes = [r[0] for r in grown.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert grown.count() == 6000 and len(sizes) == 32 and max(sizes) - min(sizes) < 0.15 * sum(sizes) / 32
    assert sum(searched) < 6000, "four levels of whole nodes are 24,000 rows"
