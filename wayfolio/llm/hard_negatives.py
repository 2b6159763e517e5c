"""Hard negatives of anchors: rows of another label whose score lies in a window below each positive's score.

The windows of an anchor overlap, so they are cut into slots at the positives' upper limits. Every task keeps the best k of
each slot only, slots of all tasks are cut to their best k again, and because slots are disjoint and descending, the best k
of a window are the first k of the slots from its own downwards.

Anchors are a stated query set; they meet all rows in blocks of bounded size (rows x anchors), never as single pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfolio.llm.common import stored

#: A block is at most so many rows against so many anchors, by a hash of the id.
ROWS, ANCHORS = 1 << 17, 1 << 13
#: Below this many rows a block isn't cut further to occupy more cores.
LEAST_ROWS = 4096
#: Scores of so many pairs are held at once.
TILE = 1 << 22
SCALE = 256


def usable_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): integer components floor(scale * x).

    Rows without id, label or vector, or with a null or non-finite component, are left out. Of rows that repeat an id the
    one with the smallest label, then the smallest vector, stays. An empty vector scores 0 with everything; vectors of
    different lengths meet as if the shorter one ended in zeros. ``scale * x`` and all scores have to fit a long.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    first = whole.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), q.alias("q")).alias("own"))
    return first.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.q")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), inside] = flat
    return out


class _Block:
    """Rows in order of id, against anchors: exact integer scores, tile by tile."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        width = max((int(np.diff(t["q"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (rows, anchors) if len(t)), default=0)
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        self.ids, self.labels = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.anchor_ids, self.anchor_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        q, a = _matrix(rows["q"], width)[order], _matrix(anchors["q"], width)
        top = max(float(np.abs(q.astype(float)).max(initial=0)), float(np.abs(a.astype(float)).max(initial=0)))
        bound = top * top * max(width, 1)
        # floating point sums of integers are exact below these bounds, whatever their order
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        self.q, self.a = q.astype(kind), a.astype(kind)

    def scores(self):
        """(anchor number, its scores with all rows)."""
        step = max(1, TILE // max(1, len(self.ids)))
        for k in range(0, len(self.a), step):
            tile = (self.a[k:k + step] @ self.q.T).astype(np.int64)
            for j, own in enumerate(tile):
                yield k + j, own


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Those ``k`` of the places ``at`` (in order of id) with the highest scores, ties by smaller id."""
    if len(at) <= k:
        return at
    own = scores[at]
    cut = np.partition(own, len(own) - k)[len(own) - k]
    above = at[own > cut]
    return np.concatenate([above, at[own == cut][:k - len(above)]])


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns, strict=True)})


def _positives(count: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, parts = _Block(rows, anchors), []
        by_label = {x: np.flatnonzero(block.labels == x) for x in np.unique(block.anchor_labels)}
        for j, own in block.scores():
            at = by_label[block.anchor_labels[j]]
            at = _best(own, at[block.ids[at] != block.anchor_ids[j]], count)
            parts.append((np.full(len(at), block.anchor_ids[j]), block.ids[at], own[at]))
        return _table(parts, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(count: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, parts = _Block(rows, anchors), []
        uppers, lowest = anchors["uppers"].to_pylist(), anchors["lowest"].to_numpy()
        for j, own in block.scores():
            limits = np.array(uppers[j][::-1], np.int64)  # ascending
            at = np.flatnonzero((own <= limits[-1]) & (own >= lowest[j]) & (block.labels != block.anchor_labels[j]))
            slots = len(limits) - 1 - np.searchsorted(limits, own[at])
            for slot in range(len(limits)):
                best = _best(own, at[slots == slot], count)
                parts.append((np.full(len(best), block.anchor_ids[j]), np.full(len(best), slot), block.ids[best], own[best]))
        return _table(parts, ["anchor_id", "slot", "negative_id", "negative_score"])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, groups: int, parts: int, run, schema: str) -> DataFrame:
    """``run`` over every (group of rows, part of the anchors)."""
    number = F.xxhash64("vec_id")
    left = rows.withColumn("g", F.pmod(number, F.lit(groups))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # named anew, since both sides come from one table
    right = anchors.withColumn("a", F.pmod(number, F.lit(parts)).cast("int"))
    right = right.select(*(F.col(c).alias(c) for c in right.columns)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    return left.groupBy("g", "a").cogroup(right.groupBy("g", "a")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame, anchors: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, relabel: int = 0
) -> DataFrame:
    """For anchors (ids divisible by ``anchors``) and each of their ``positives`` best rows of the same label, the first
    ``negatives`` rows of another label with ``low`` to ``high`` percent of the positive's score.

    Higher scores come first, ties by smaller id. With ``relabel`` the labels of ids divisible by it are moved on by one
    modulo ten (noise to mine against). A positive below zero has an empty window. An anchor without another row of its
    label, or a window without rows, gives no row; an empty table gives none. See ``usable_vectors`` for rows left out.
    """
    vectors = usable_vectors(rows)
    if relabel:
        moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        vectors = vectors.withColumn("label", moved)
    vectors = stored(vectors, "vectors")
    chosen = vectors.filter(F.col("vec_id") % anchors == 0)
    n, n_chosen = vectors.count(), chosen.count()
    cores = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, parts = max(1, -(-n // ROWS), min(cores, n // LEAST_ROWS)), max(1, -(-n_chosen // ANCHORS))

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _meet(vectors, chosen, groups, parts, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    own = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    own = own.select("anchor_id", "positive_id", "positive_score").filter("positive_score >= 0")
    score = F.col("positive_score")
    limits = own.withColumn("upper", F.floor((score * high - F.pmod(score * high, F.lit(100))) / 100).cast("long"))
    limits = limits.withColumn("lower", F.floor((score * low + F.pmod(-score * low, F.lit(100))) / 100).cast("long"))
    windows = stored(limits, "windows")

    each = windows.groupBy("anchor_id").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("lowest")
    )
    seekers = chosen.join(each.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    schema = "anchor_id long, slot long, negative_id long, negative_score long"
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    slots = _meet(vectors, seekers, groups, parts, _negatives(negatives), schema)
    slots = slots.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= negatives)
    # at most positives x negatives entries an anchor, in descending order: slots follow one another
    entry = F.struct((-F.col("negative_score")).alias("minus"), F.col("negative_id").alias("id"))
    ladder = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("ladder"))
    below = F.slice(F.filter("ladder", lambda e: -e.minus <= F.col("upper")), 1, negatives)
    inside = F.filter(below, lambda e: -e.minus >= F.col("lower"))
    return windows.join(ladder, "anchor_id").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "entry")
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.id").alias("negative_id"),
        "positive_score", (-F.col("entry.minus")).alias("negative_score"),
    )
