"""Numbering and neighbour lookups inside groups of any size.

A window function would put a whole group into one task. Instead the rows are put into ranges of (keys, order), stored
once, and numbered inside each range; a small table with one row per group and range supplies what the ranges before or
after contribute. There is one path for all sizes and types: a range holds rows, not groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfolio.session import materialize

#: Above this many rows per key the engine no longer cuts groups before the shuffle.
GROUP_LIMIT = 1000


def _same(left: DataFrame, right: DataFrame, pairs) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def _attach(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on the named columns, null-safe, without repeating them."""
    renamed = right.select(*[F.col(n).alias(f"__{n}") for n in names], *[c for c in right.columns if c not in names])
    joined = left.join(renamed, _same(left, renamed, [(n, f"__{n}") for n in names]), "left")
    return joined.drop(*[f"__{n}" for n in names])


def _own_value(df: DataFrame) -> Column:
    """A hash of the row, which a task that runs again finds again."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind])


def ranged(df: DataFrame, keys: list[str], order: list, partitions: int | None = None) -> DataFrame:
    """``df`` stored in ranges of (keys, order), with the number of the range (``_part``) and the place in it (``_at``).

    Names in ``order`` sort ascending, nulls last; rows that tie are ordered by their own values, so ties don't pile up.
    """
    sort = [*(F.asc_nulls_last(k) for k in keys), *(F.asc_nulls_last(o) if isinstance(o, str) else o for o in order), _own_value(df).asc()]
    spread = df.repartitionByRange(*([partitions] if partitions else []), *sort).sortWithinPartitions(*sort)
    placed = materialize(spread.withColumn("_row", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_row", 33)).withColumn("_at", F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row")


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str = "number", partitions: int | None = None) -> DataFrame:
    """1..n inside each group in the given order; without keys, over all rows."""
    rows = ranged(df, keys, order, partitions)
    slices = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = slices.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    joined = _attach(rows, starts, [*keys, "_part"])
    return joined.withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint")).drop("_part", "_at", "_shift")


def ordered(df: DataFrame, order: list, name: str = "position", partitions: int | None = None) -> DataFrame:
    """All rows with their position in the whole order, nulls last where ``order`` gives names."""
    return row_numbers(df, [], order, name, partitions)


def neighbors(
    df: DataFrame, keys: list[str], order: list, previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None, partitions: int | None = None,
) -> DataFrame:
    """Values of the row before and after, inside each group in the given order.

    ``previous`` and ``following`` map new column names to the source column.
    """
    previous, following = previous or {}, following or {}
    taken = sorted({*previous.values(), *following.values()})
    rows = ranged(df, keys, order, partitions)
    groups = [*keys, "_part"]
    within = W.partitionBy(*groups).orderBy("_at")
    edge = F.struct(*[F.col(c) for c in taken])
    edges = rows.groupBy(*groups).agg(F.min_by(edge, "_at").alias("_head"), F.max_by(edge, "_at").alias("_tail"))
    across = W.partitionBy(*keys).orderBy("_part")
    links = edges.select(*groups, F.lag("_tail").over(across).alias("_edge_before"), F.lead("_head").over(across).alias("_edge_after"))
    here = F.struct(*[F.col(c) for c in taken])
    out = rows.withColumn("_own_before", F.lag(here).over(within)).withColumn("_own_after", F.lead(here).over(within))
    out = _attach(out, links, groups)
    for new, source in previous.items():
        out = out.withColumn(new, F.coalesce("_own_before", "_edge_before")[source])
    for new, source in following.items():
        out = out.withColumn(new, F.coalesce("_own_after", "_edge_after")[source])
    return out.drop("_own_before", "_own_after", "_edge_before", "_edge_after", "_part", "_at")


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    A hot key costs no more than a cold one: the engine cuts each group to ``n`` rows before the shuffle. It does so up to
    GROUP_LIMIT rows. For more, rows are numbered in ranges of (keys, order), which part a hot key as well; the ranges are
    stored while this is built, and rows that tie are taken by their own values. Column expressions are allowed in ``order``.
    """
    name = rank or "_rank"
    if n > GROUP_LIMIT:
        # Names sort nulls first here, as in a window.
        sort = [F.asc(o) if isinstance(o, str) else o for o in order]
        ranked = row_numbers(df, keys, sort, name)
    else:
        ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept.withColumn(name, F.col(name).cast("bigint")) if rank else kept.drop(name)
