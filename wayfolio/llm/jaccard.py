"""Documents whose shingle sets are alike: an exact similarity join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfolio.llm.common import small_batches, stored
from wayfolio.llm.components import components
from wayfolio.llm.decontamination import small
from wayfolio.llm.kernels import mix, shingle_sets

SHINGLE, PERCENT = 3, 90
#: Longest prefix extension that is weighed, and what checking a candidate costs relative to reading a posting.
MOST_MATCHES, CHECK_COST = 8, 8.0
#: Bytes of shingles that meet in one reducer, and that are one block on the sending side.
BUCKET_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20
#: Rounds that link each set to the most central set it meets, before all remaining pairs are taken up.
STAR_ROUNDS = 2

_SKETCH = pa.schema([
    ("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("block", pa.int64()), ("place", pa.int32()),
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("set_sum", pa.int64()), ("set_mix", pa.int64()),
    ("sampled", pa.int64()), ("met", pa.int64()),
])
_SKETCH_DDL = (
    "bucket int, hashes binary, places binary, block bigint, place int, doc_id bigint, mark bigint, n bigint, set_sum bigint, "
    "set_mix bigint, sampled bigint, met bigint"
)


def _needed(n: Column, percent: int) -> Column:
    """Shingles a set of ``n`` must share with any set it links to."""
    return F.ceil(n * percent / 100).cast("long")


def _sketches(size: int, rate: float, buckets: int):
    """Maps batches (doc_id, mark, text) to a row per document and the sampled shingles of each block, by bucket.

    The sample is every shingle below a fixed hash value, the same for all documents. A shingle several texts of a block
    hold is sent once for the block and counted as ``met`` for them at once, so a shingle of all documents is sent once
    per block. The ``places`` of a shingle is its only text in the block, or -1.
    """
    limit = np.uint64(min(2**64 - 1, int(rate * 2**64)))
    width = np.uint64(min(2**64 - 1, int(limit) // buckets + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, held, taken = part << 32, [], 0

        def close(block, held):
            sets = [s for _, _, s in held]
            samples = [s[:np.searchsorted(s, limit, side="right")] for s in sets]
            lengths = np.array([len(s) for s in samples], np.int64)
            flat = np.concatenate(samples) if samples else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(samples), dtype=np.int32), lengths)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            counts = np.diff(np.append(at, len(flat)))
            alone = counts == 1
            met = np.bincount(owner[np.repeat(~alone, counts)], minlength=len(sets))
            hashes, places = flat[at], np.where(alone, owner[at], -1).astype(np.int32)
            bucket = (hashes // width).astype(np.int32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            none, n = [None] * len(used), len(sets)
            yield _batch(
                used.tolist(), [hashes[cuts[b]:cuts[b + 1]].tobytes() for b in used],
                [places[cuts[b]:cuts[b + 1]].tobytes() for b in used], [block] * len(used), *[none] * 8,
            )
            yield _batch(
                [None] * n, [None] * n, [None] * n, [block] * n, list(range(n)), [d for d, _, _ in held], [m for _, m, _ in held],
                [len(s) for s in sets], [int(np.sum(s, dtype=np.uint64).astype(np.int64)) for s in sets],
                [int(np.sum(mix(s), dtype=np.uint64).astype(np.int64)) for s in sets], lengths.tolist(), met.tolist(),
            )

        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, mark, found in zip(ids, marks, shingle_sets(batch.column(2), size), strict=True):
                held.append((doc_id, mark, found))
                taken += 8 * len(found) + 64
                if taken >= BLOCK_BYTES:
                    yield from close(block, held)
                    block, held, taken = block + 1, [], 0
        if held:
            yield from close(block, held)

    return run


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SKETCH, strict=True)], schema=_SKETCH)


def _met_elsewhere(table: pa.Table) -> pa.Table:
    """Of one bucket, a row per block: for texts that alone in the block hold a shingle, how many of those others hold."""
    blocks = np.repeat(table["block"].to_numpy(), [len(x) // 8 for x in table["hashes"].to_pylist()])
    hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
    places = np.frombuffer(b"".join(table["places"].to_pylist()), np.int32)
    order = np.argsort(hashes, kind="stable")
    hashes, places, blocks = hashes[order], places[order], blocks[order]
    twice = np.zeros(len(hashes), bool)
    same = hashes[1:] == hashes[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    twice &= places >= 0
    key, counts = np.unique(np.stack([blocks[twice], places[twice].astype(np.int64)]), axis=1, return_counts=True)
    own, first = np.unique(key[0], return_index=True)
    cut = [np.split(x.astype("<u4"), first[1:]) if len(own) else [] for x in (key[1], counts)]
    return pa.table({"block": pa.array(own, pa.int64()), **{
        name: pa.array([x.tobytes() for x in parts], pa.binary()) for name, parts in zip(("places", "counts"), cut, strict=True)}})


def _summed(table: pa.Table) -> pa.Table:
    """The counts of one block's texts over all buckets."""
    places, counts = (np.concatenate([np.frombuffer(x, "<u4") for x in table[c].to_pylist()]).astype(np.int64) for c in ("places", "counts"))
    total = np.bincount(places, weights=counts).astype(np.int64)
    at = np.flatnonzero(total)
    return pa.table({"block": np.full(len(at), table["block"][0].as_py()), "place": pa.array(at, pa.int32()), "elsewhere": total[at]})


def _arrays(size: int):
    """Maps batches (node, text) to rows (node, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), size))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "hashes"])

    return run


def _alone(texts: DataFrame, size: int, rate: float, shingles: int) -> DataFrame:
    """Rows (doc_id, mark, n, set_sum, set_mix, alone): how many sampled shingles of a text no other text holds.

    ``shingles`` is about how many the texts have in all; it only sets the number of buckets.
    """
    buckets = max(1, -(-int(shingles * rate * 12) // BUCKET_BYTES))
    sketch = stored(texts.select("doc_id", "mark", "text").mapInArrow(_sketches(size, rate, buckets), _SKETCH_DDL), "sketch")
    elsewhere = (
        sketch.filter("bucket is not null").select("bucket", "hashes", "places", "block").groupBy("bucket")
        .applyInArrow(_met_elsewhere, "block bigint, places binary, counts binary")
        .groupBy("block").applyInArrow(_summed, "block bigint, place int, elsewhere bigint")
    )
    rows = sketch.filter("bucket is null").join(elsewhere, ["block", "place"], "left")
    alone = F.col("sampled") - F.col("met") - F.coalesce("elsewhere", F.lit(0))
    return rows.select("doc_id", "mark", "n", "set_sum", "set_mix", alone.alias("alone"))


def _may_link(percent: int) -> Column:
    """At most ``n - needed`` shingles can be missing from a set that a set of ``n`` links to."""
    return F.col("alone") <= F.col("n") - _needed(F.col("n"), percent)


def _texts_of(source: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of the first text of each of ``sets``, with the node as doc_id."""
    first = small(stored(sets.select("node", F.col("first.doc_id").alias("id"), F.col("first.mark").alias("of")), "firsts"))
    met = source.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")))
    return met.select(F.col("node").alias("doc_id"), "mark", "text")


def _candidates(source: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored documents (doc_id, mark, n, set_sum, set_mix), distinct sets (node, n, ...), and those that may link.

    First a sample of all shingles is compared, then all shingles of the sets that are left; the others' are never sent
    anywhere.
    """
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rate = min(1.0, 2 * (100 - percent) / 100)
    rows = stored(_alone(source, size, rate, volume // 6).withColumn("company", _may_link(percent)), "sets")
    distinct = rows.filter("n > 0").groupBy("n", "set_sum", "set_mix").agg(
        F.min(F.struct("doc_id", "mark")).alias("first"), F.max("company").alias("company"), F.min("doc_id").alias("least"),
    )
    sets = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    left = sets.filter("company")
    shingles = left.agg(F.sum("n")).first()[0] or 0
    linking = _alone(_texts_of(source, left), size, 1.0, shingles).filter(_may_link(percent)).select(F.col("doc_id").alias("node")).distinct()
    return rows.drop("alone", "company"), sets, stored(sets.join(linking, "node").select("node", "n", "first"), "linking")


def _prefixes(arrays: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored prefixes (node, hash, at, n, own, matches) of the sets that can still link; ``at`` is the place in the order.

    Shingles are ordered by the number of sets that hold them, then by hash; those of one set alone (``own`` of them)
    come first. With ``needed`` shared shingles, the first n - needed + m of two linked sets share at least m. Each set
    takes the m with the least estimated cost: the postings its prefix meets, plus a check for each m of them.
    """
    held = arrays.select("node", F.explode("hashes").alias("hash"))
    counts = held.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    shared = held.join(counts, "hash")
    whole = Window.partitionBy("node")
    order = whole.orderBy("df", "hash")
    ranked = shared.withColumn("at", F.row_number().over(order)).withColumn(
        "postings", F.sum(F.col("df") - 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("common", F.count("*").over(whole))
    placed = ranked.join(sets.select("node", "n"), "node").withColumn("own", F.col("n") - F.col("common")).withColumn(
        "spare", F.col("n") - _needed(F.col("n"), percent)
    ).withColumn("at", F.col("own") + F.col("at"))
    placed = stored(placed.filter((F.col("own") <= F.col("spare")) & (F.col("at") <= F.col("spare") + MOST_MATCHES))
                    .select("node", "hash", "n", "own", "spare", "at", "postings"), "placed")
    m = F.col("at") - F.col("spare")
    cost = F.col("postings") * (1 + F.lit(CHECK_COST) / m)
    best = placed.filter(m >= 1).groupBy("node").agg(F.min(F.struct(cost.alias("cost"), m.alias("m"))).alias("best"))
    prefix = placed.join(best.select("node", F.col("best.m").alias("matches")), "node").filter(
        F.col("at") <= F.col("spare") + F.col("matches")
    )
    return stored(prefix.select("node", "hash", "at", "n", "own", "matches"), "prefixes")


def _compared(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) by their whole sets, stored: ``gap``, in how many shingles they differ, ``extra``, those of a, and
    ``alike``."""
    pairs = stored(pairs, "pairs")
    both = pairs.join(arrays.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        arrays.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"),
                          F.size("x").alias("size_a"))
    alike = F.col("common") * 100 >= F.lit(percent) * (F.col("sizes") - F.col("common"))
    return stored(counted.select("a", "b", (F.col("sizes") - 2 * F.col("common")).alias("gap"), (F.col("size_a") - F.col("common")).alias("extra"),
                                 alike.alias("alike")), "compared")


def _labelled(prefix: DataFrame, links: DataFrame, first: DataFrame) -> DataFrame:
    """Prefix rows with the ``label`` of their set's component so far, and the set's ``center``, ``gap`` and ``extra`` to it."""
    labels = components(links).withColumnRenamed("node", "of")
    centers = first.select(F.col("a").alias("with"), F.col("b").alias("center"), "gap", "extra")
    rows = prefix.join(labels, prefix.node == labels.of, "left").join(centers, prefix.node == centers["with"], "left")
    return stored(rows.select(*prefix.columns, F.coalesce("label", "node").alias("label"), F.coalesce("center", "node").alias("center"),
                              F.coalesce("gap", F.lit(0)).alias("gap"), F.coalesce("extra", F.lit(0)).alias("extra")), "labelled")


_SIDE = ("node", "n", "own", "label", "center", "gap", "extra")


def _star_pairs(prefix: DataFrame, percent: int, round_: int) -> DataFrame:
    """For each set the one set, of those central to its shingles, that it meets most often: at most one pair per set.

    Central is the set with the fewest shingles of its own; later rounds try others.
    """
    rank = F.struct("own", "node") if round_ == 0 else F.struct(F.xxhash64("node", F.lit(round_)), "node")
    centers = prefix.groupBy("hash").agg(
        F.min(F.struct(rank.alias("rank"), *_SIDE)).alias("c"), F.count("*").alias("k")
    ).filter("k > 1").select("hash", *(F.col(f"c.{c}").alias(f"{c}_b") for c in _SIDE))
    met = prefix.select("hash", *(F.col(c).alias(f"{c}_a") for c in _SIDE)).join(centers, "hash").filter(_in_reach(percent))
    per = met.groupBy("node_a", "node_b").agg(F.count("*").alias("k"))
    best = per.groupBy("node_a").agg(F.max(F.struct("k", "node_b")).alias("best"))
    return best.select(F.col("node_a").alias("a"), F.col("best.node_b").alias("b"))


def _in_reach(percent: int) -> Column:
    """Whether two sets of different components, not compared yet, may link by what is known of them.

    A set's own shingles are not shared, and add to the other's size. Two sets that were compared with the same center
    differ in ``gap_a + gap_b`` shingles less twice those in which both differ from it in the same way: extra shingles of
    both, among which a set's own never are, and missing ones of both.
    """
    a, b = ({c: F.col(f"{c}_{x}") for c in _SIDE} for x in "ab")
    most = F.least(a["n"] - a["own"], b["n"] - b["own"])
    sizes = most * 100 >= F.greatest(a["n"] + b["own"], b["n"] + a["own"]) * percent
    same_extra = F.greatest(F.lit(0), F.least(a["extra"] - a["own"], b["extra"] - b["own"]))
    same_way = same_extra + F.least(a["gap"] - a["extra"], b["gap"] - b["extra"])
    apart = a["gap"] + b["gap"] - 2 * same_way
    near = (a["center"] != b["center"]) | (apart * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent))
    unseen = (a["center"] != b["node"]) & (b["center"] != a["node"])
    return (a["label"] != b["label"]) & unseen & sizes & near


def _remaining_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets from different components that share as many prefix shingles as either of them asks for.

    A shingle whose sets are all in one component gives none. Elsewhere the sets outside the largest component are
    compared with the others, so members of one component are not paired. Of a pair that must share ``most`` shingles only
    the first n - most + m of each count, a shorter prefix than either set's own.
    """
    groups = prefix.groupBy("hash", "label").agg(F.count("*").alias("k"))
    mixed = groups.groupBy("hash").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = stored(mixed.select("hash", F.col("top.label").alias("top")), "mixed")
    rows = stored(prefix.join(mixed, "hash"), "meeting")
    side = lambda x: rows.select("hash", "top", *(F.col(c).alias(f"{c}_{x}") for c in (*_SIDE, "matches", "at")))
    left, right = side("a").filter("label_a <> top").drop("top"), side("b")
    once = (F.col("label_b") == F.col("top")) | (F.col("node_a") < F.col("node_b"))
    most = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent)) - F.least("matches_a", "matches_b")
    early = (F.col("at_a") <= F.col("n_a") - most) & (F.col("at_b") <= F.col("n_b") - most)
    met = left.join(right, "hash").filter(once & early & _in_reach(percent))
    pair = met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(
        F.count("*").alias("k"), F.first(F.least("matches_a", "matches_b")).alias("asked")
    )
    return pair.filter("k >= asked").select("a", "b")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, identity: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when their sets of distinct ``size``-word shingles have Jaccard similarity of at least ``percent``
    / 100. Words are split at ASCII white space, A-Z lower-cased.

    * A text of fewer words than ``size`` has one shingle, all its words. Null, empty or blank texts have none and link
      with nothing, not even with each other; their component is their own id.
    * Equal sets are folded first, whatever their number, so groups of copies cost one set. A null id is never a
      component's smallest unless all are null.
    * Texts are read whole. Other columns are not read. An empty table gives no rows.
    * ``mark`` is a hash of the text, with which (doc_id, mark) leads back to the rows.

    Links are complete up to components: pairs inside a component that is already connected are not compared again, every
    other pair that the prefixes admit is.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(identity).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"),
                         F.col(text).cast("string").alias("text"))
    rows, sets, linking = _candidates(source, size, percent)
    arrays = _texts_of(source, linking).select(F.col("doc_id").alias("node"), "text").mapInArrow(_arrays(size), "node bigint, hashes array<bigint>")
    arrays = stored(arrays, "arrays")
    if not arrays.groupBy("node").count().filter("count > 1").isEmpty():  # rows that repeat an id and a text
        arrays = stored(arrays.groupBy("node").agg(F.any_value("hashes").alias("hashes")), "arrays")
    prefix = _prefixes(arrays, linking, percent)

    first, links = None, None
    # no set has a center yet: -node is the center of no other
    labelled = prefix.withColumns({"label": F.col("node"), "center": -F.col("node") - 1, "gap": F.lit(0), "extra": F.lit(0)})
    for round_ in range(STAR_ROUNDS + 1):
        pairs = _star_pairs(labelled, percent, round_) if round_ < STAR_ROUNDS else _remaining_pairs(labelled, percent)
        compared = _compared(pairs, arrays, percent)
        found = compared.filter("alike").select("a", "b")
        first, links = (compared, found) if links is None else (first, links.unionByName(found))
        if round_ < STAR_ROUNDS:
            labelled = _labelled(prefix, links, first)

    labels = components(links)
    grouped = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component"))
    keys = ["n", "set_sum", "set_mix"]
    of_set = stored(grouped.join(least, "label").select(*keys, "component"), "set_components")
    return rows.join(of_set, keys, "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id (then text hash); same columns.

    Texts without words are alone, so they all stay. Of rows that repeat an id and a text one stays.
    """
    placed = stored(jaccard_components(docs, size, percent, identity, text), "placed")
    best = F.min(F.struct(F.col("doc_id"), F.col("mark"))).alias("best")
    first = placed.filter("n_shingles > 0").groupBy("component_id").agg(best).select("best.doc_id", "best.mark")
    alone = placed.filter("n_shingles = 0").select("doc_id", "mark").distinct()
    stays = stored(first.unionByName(alone).select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")), "stays")
    again = stored(
        placed.groupBy("doc_id", "mark").agg(F.count("*").alias("k")).filter("k > 1")
        .select(F.col("doc_id").alias("twice_id"), F.col("mark").alias("twice_mark")), "again",
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(identity).cast("long").alias("key_id"), F.xxhash64(text).alias("key_mark"))
    kept = rows.join(stays, F.col("key_id").eqNullSafe(F.col("kept_id")) & (F.col("key_mark") == F.col("kept_mark")), "left_semi")
    if again.isEmpty():
        return kept.select("row.*")
    repeated = F.col("key_id").eqNullSafe(F.col("twice_id")) & (F.col("key_mark") == F.col("twice_mark"))
    once = kept.join(again, repeated, "left_semi").groupBy("key_id", "key_mark").agg(F.any_value("row").alias("row"))
    return kept.join(again, repeated, "left_anti").select("row.*").unionByName(once.select("row.*"))
