"""Sharding by a k-d tree over metadata: weighted medians along the widest dimension, until leaves are small."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfolio.llm.common import before_each, bucket_count, filled, key_bucket, random_key, stored
from wayfolio.llm.decontamination import small

#: A point on one dimension: 20 bits of the coordinate, then 22 of the text's checksum and 20 of the id's hash. The
#: tail makes every coordinate divisible and keeps equal texts side by side.
COORD, TEXT_BITS, ID_BITS = 20, 22, 20
BINS = 4096
#: A cut found by histograms may miss its median by this share of a leaf.
SLACK = 0.002
#: Nodes of at most so many rows are split to the end in one task each; larger ones by distributed histograms.
TASK_ROWS = 50_000


def metadata(text: str = "text", source: str = "source", lang: str = "lang") -> dict[str, Column]:
    """The dimensions of documents: size on a log scale, source and language each as a place on a line."""
    named = lambda c: F.shiftright(F.crc32(F.encode(filled(F.col(c)), "UTF-8")), 32 - COORD)
    size = F.octet_length(filled(F.col(text))) + 16
    return {"size": F.floor(F.log2(size) * F.lit(1 << (COORD - 5))), "source": named(source), "lang": named(lang)}


def _points(dims: dict[str, Column], identity: str, text: str) -> list[Column]:
    crc = F.crc32(F.encode(filled(F.col(text)), "UTF-8"))
    tail = F.shiftleft(F.shiftright(crc, 32 - TEXT_BITS), ID_BITS) + F.shiftright(random_key(F.col(identity)), 60 - ID_BITS)
    return [
        F.col(identity).alias("doc_id"), (F.octet_length(filled(F.col(text))) + 16).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        F.array(*(F.shiftleft(c.cast("long"), TEXT_BITS + ID_BITS) + tail for c in dims.values())).alias("at"),
    ]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("size").alias("w"), F.min("value").alias("lo"), (F.max("value") + 1).alias("hi")]


def _bins(rows: DataFrame, lows: list[int], steps: list[int]) -> DataFrame:
    """Per node (first, leaves), dimension and bin of one grid over the whole: rows, weight and the range [lo, hi) of values.

    Summed before they move, at most ``BINS`` a dimension, node and task. Rows meet no table for it.
    """
    parts = []
    for d, (low, step) in enumerate(zip(lows, steps, strict=True)):
        value = F.col("at")[d]
        parts.append(rows.select("first", "leaves", "size", value.alias("value"), F.expr(f"(at[{d}] - {low}L) div {step}L").alias("bin")).groupBy(
            "first", "leaves", "bin").agg(*_sums()).withColumn("dim", F.lit(d)))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def _nodes(bins: DataFrame, base: list[int]) -> DataFrame:
    """Per node: its rows, its weight and its widest dimension, relative to the whole; the first of equally wide ones."""
    sides = bins.groupBy("first", "leaves", "dim").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), (F.max("hi") - F.min("lo") - 1).alias("spread"))
    width = F.col("spread") / F.element_at(F.array(*map(F.lit, base)), F.col("dim") + 1)
    return sides.groupBy("first", "leaves").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.max_by("dim", F.struct(width, -F.col("dim"))).alias("dim"))


def _within(inside: DataFrame, opened: DataFrame) -> DataFrame:
    """Of every open search the bin that holds the median: its border is the cut, or its values are the next range.

    ``inside`` has (first, bin, w, lo, hi), ``opened`` the searches (first, dim, left, slack).
    """
    holds = before_each(inside, ["first"], "bin", "w", "before").join(opened, "first").filter("before < left AND before + w >= left")
    settled = (F.col("w") <= F.col("slack")) | (F.col("hi") - F.col("lo") == 1)
    nearest = F.when(F.col("left") - F.col("before") > F.col("before") + F.col("w") - F.col("left"), F.col("hi")).otherwise(F.col("lo"))
    return holds.select("first", "dim", "lo", "hi", (F.col("left") - F.col("before")).alias("left"), "slack", F.when(settled, nearest).alias("cut"))


def _searches(bins: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cut each node wants, as far as the bins tell it: the range [lo, hi) that holds it, and the weight left of it."""
    left = F.col("w") * F.ceil(F.col("leaves") / 2) / F.col("leaves")
    wanted = nodes.select("first", "dim", left.alias("left"), (F.col("w") * F.lit(SLACK) / F.col("leaves")).alias("slack"))
    inside = bins.join(small(wanted.select("first", "dim")), ["first", "dim"]).select("first", "bin", "w", "lo", "hi")
    return _within(inside, wanted)


def _narrow(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """One histogram round over the rows in open ranges. Bins are summed before they move, at most ``BINS`` a node and task."""
    opened = searches.filter("cut IS NULL").withColumn("step", F.expr(f"(hi - lo + {BINS - 1}) div {BINS}"))
    ranges = small(opened.select("first", "dim", F.col("lo").alias("from"), F.col("hi").alias("to"), "step"))
    inside = (
        rows.join(ranges, "first").withColumn("value", F.element_at(F.col("at"), F.col("dim") + 1)).filter("value >= from AND value < to")
        .groupBy("first", F.expr("(value - from) div step").alias("bin")).agg(*_sums())
    )
    return _within(inside, opened.select("first", "dim", "left", "slack")).unionByName(searches.filter("cut IS NOT NULL"))


def _halve(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows move to the left or right child of their node: a child has half of the leaves, the left one the odd one."""
    more, fewer = F.ceil(F.col("leaves") / 2).cast("long"), F.floor(F.col("leaves") / 2).cast("long")
    left = F.element_at(F.col("at"), F.col("dim") + 1) < F.col("cut")
    cut = rows.join(small(cuts.select("first", "dim", "cut")), "first")
    return cut.withColumn("first", F.when(left, F.col("first")).otherwise(F.col("first") + more)).withColumn(
        "leaves", F.when(left, more).otherwise(fewer)).select(*rows.columns)


def split_points(at: np.ndarray, size: np.ndarray, first: int, leaves: int, base: list[int]) -> np.ndarray:
    """The shard of each point of one node, by the same rule with exact medians."""
    shard = np.empty(len(size), np.int64)
    todo = [(np.arange(len(size)), first, leaves)]
    while todo:
        own, first, leaves = todo.pop()
        if leaves == 1 or not len(own):
            shard[own] = first
            continue
        dim = int(np.argmax((at[own].max(0) - at[own].min(0)) / np.array(base, float)))
        order = own[np.argsort(at[own, dim], kind="stable")]
        values, weight = at[order, dim], np.cumsum(size[order])
        more = -(-leaves // 2)
        wanted = weight[-1] * more / leaves
        middle = values[np.searchsorted(weight, wanted)]
        begin, end = np.searchsorted(values, middle), np.searchsorted(values, middle, "right")
        before, through = (weight[begin - 1] if begin else 0), weight[end - 1]
        at_cut = end if wanted - before > through - wanted else begin
        todo += [(order[:at_cut], first, more), (order[at_cut:], first + more, leaves // 2)]
    return shard


def grow_tree(points: DataFrame, dims: int, leaves: int) -> DataFrame:
    """``points`` (stored; size, at and others) with ``shard``, numbered from left to right.

    A node is the range of shards [first, first + leaves) below it, and rows carry it; the tree is never one object.
    Level by level, nodes of more than ``TASK_ROWS`` rows are cut at weighted medians, all of a level together: per
    node the widest dimension, relative to the whole, and the bin that holds the median, both from one grid of bins;
    then histograms of ever narrower ranges, over the rows in them alone. Cuts are a table of one row per such node,
    sent to every executor while it is short; each row meets it once a level, so that the work is (rows) x (levels).
    Smaller nodes are split to their leaves in one task each. The driver sees the limits of the whole and one count
    per round.

    * Rows that agree in the dimension that is cut stay together, on the side that brings the cut nearer to its
      weight; at equal distance on the right. A node of equal rows is one shard, and its other shards are empty.
    """
    whole = points.agg(*(F.coalesce(f(F.col("at")[d]), F.lit(0)) for f in (F.min, F.max) for d in range(dims))).first()
    lows = list(whole[:dims])
    base = [max(1, high - low) for low, high in zip(lows, whole[dims:], strict=True)]
    steps = [spread // BINS + 1 for spread in base]
    rows = points.withColumn("first", F.lit(0).cast("long")).withColumn("leaves", F.lit(leaves).cast("long"))
    ready, handed = [], []
    for _ in range((leaves - 1).bit_length()):
        bins = stored(_bins(rows.filter("leaves > 1"), lows, steps), "bins")
        nodes = stored(_nodes(bins, base), "nodes")
        large = nodes.filter(F.col("n") > TASK_ROWS)
        if large.isEmpty():
            break
        handed.append(rows.join(small(nodes.filter(F.col("n") <= TASK_ROWS).select("first")), "first", "left_semi"))
        ready.append(rows.filter("leaves = 1"))
        searches = stored(_searches(bins, large), "searches")
        while not searches.filter("cut IS NULL").isEmpty():
            searches = stored(_narrow(rows, searches), "searches")
        rows = stored(_halve(rows, searches), "level")
    handed.append(rows.filter("leaves > 1"))
    ready.append(rows.filter("leaves = 1"))

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        at = group["at"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        shard = split_points(at, group["size"].to_numpy(), key[0].as_py(), key[1].as_py(), base)
        return group.drop_columns(["first", "leaves"]).append_column("shard", pa.array(shard.astype(np.int32)))

    united = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(united(parts[1:]))
    settled = united(ready).withColumn("shard", F.col("first").cast("int")).drop("first", "leaves")
    ended = united(handed).groupBy("first", "leaves").applyInArrow(finish, settled.schema)
    return stored(settled.unionByName(ended), "placed")


def placed_points(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dims: dict[str, Column] | None = None,
                  identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (doc_id, size, text_crc32, at, shard); give ``leaves`` or the bytes a leaf shall have."""
    dims = dims or metadata(text)
    points = stored(docs.select(*_points(dims, identity, text)), "points")
    if leaves is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, math.ceil(total / target_bytes))
    return grow_tree(points, len(dims), leaves)


def numbered_shards(points: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in each shard, in random order of the id).

    Slots come from counts per (shard, key range) and a window inside each range, so a shard is no single task.
    """
    rows = points.select("doc_id", "size", "text_crc32", "shard", random_key(F.col("doc_id")).alias("key"))
    rows = rows.withColumn("bucket", key_bucket(F.col("key"), bucket_count(points.count())))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = before_each(counts, ["shard"], "bucket", "n", "start").drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")) - 1
    return rows.join(stored(starts, "starts"), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + inside).cast("long").alias("slot")
    )


def kd_shards(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None,
              dims: dict[str, Column] | None = None, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot. Shards have nearly equal bytes.

    * Size is the UTF-8 bytes of the text plus 16; null text has none. A document is never cut, so a shard can miss its
      share by the size of one document.
    * Null metadata counts as empty. Rows that agree in every point bit stay together.
    * Other columns are not read. An empty table gives no rows.
    """
    return numbered_shards(placed_points(docs, leaves, target_bytes, dims, identity, text))


def sharded_documents(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, identity: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``docs`` with a column ``shard`` (replacing one of that name).

    A row finds its shard by its point, which all rows of one point share. Points are sent to the texts while there are
    few; beyond that texts are shuffled once.
    """
    dims = metadata(text)
    shards = stored(placed_points(docs, leaves, target_bytes, dims, identity, text).select("at", "shard").distinct(), "shards")
    columns = [c for c in docs.columns if c != "shard"]
    placed = docs.select(F.struct(*columns).alias("doc"), _points(dims, identity, text)[-1])
    return placed.join(small(shards), "at").select(*(F.col("doc")[c].alias(c) for c in columns), "shard")
