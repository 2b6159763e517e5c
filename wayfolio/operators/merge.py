"""Merging new rows into stored ones: fill missing fields, upsert, insert if absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.text import filled, has_text
from wayfolio.lookups import FILLABLE_COLUMNS
from wayfolio.operators.ordered import first_per_key


def left_lookup(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join on a text key that many rows lack; ``values`` has one row per key.

    Rows without a key find nothing wherever they go, so they are spread over all tasks
    instead of meeting in the one that null or blank keys hash to. The spread follows the row's
    own values, so a task that runs again sends each row where it went before.
    """
    own = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind])
    lone = F.concat(F.lit("\u0000"), F.pmod(own, F.lit(100_000)).cast("string"))
    spread = df.withColumn("_at", F.when(filled(key).isNull(), lone).otherwise(F.col(key)))
    return spread.join(values.withColumnRenamed(key, "_at"), "_at", "left").drop("_at")


def merge_fill_missing(
    existing: DataFrame, new: DataFrame, key: Column, fields=FILLABLE_COLUMNS, order: str = "arrival",
) -> DataFrame:
    """Stored rows with empty fields filled from new rows under the same key, plus the unmatched new rows.

    Of several stored rows with one key the last (by id) is the one that is filled; the others,
    and stored rows without a key, pass through. New rows without a key are dropped. Values come
    from the stored row first, then from new rows in arrival order. ``action`` tells what happened.
    """
    names = [c for c in existing.columns if c in new.columns]
    stored = existing.select(*names).withColumn("_key", key)
    fresh = new.select(*names).withColumn("_key", key).filter(F.col("_key").isNotNull())
    last = stored.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("id").alias("id"))
    current = stored.join(last, ["_key", "id"], "left_semi")
    untouched = stored.join(last, ["_key", "id"], "left_anti")

    pool = current.withColumn("_turn", F.lit(-1).cast("bigint")).unionByName(
        fresh.withColumn("_turn", F.col(order).cast("bigint"))
    )
    # A null rank is ignored by min_by, so a blank field never wins.
    picks = [
        F.coalesce(
            F.min_by(F.col(f), F.when(filled(f).isNotNull(), F.col("_turn"))), F.min_by(F.col(f), F.col("_turn"))
        ).alias(f)
        for f in fields if f in names
    ]
    rest = [F.min_by(F.col(c), F.col("_turn")).alias(c) for c in names if c not in fields]
    had = [
        (F.min(F.when(F.col("_turn") == -1, filled(f))).isNull() & F.max(filled(f)).isNotNull())
        for f in fields if f in names
    ]
    gained = had[0]
    for h in had[1:]:
        gained = gained | h
    merged = pool.groupBy("_key").agg(
        *picks, *rest,
        F.when(F.min("_turn") >= 0, F.lit("inserted"))
        .when(gained, F.lit("updated")).otherwise(F.lit("kept")).alias("action"),
    )
    return merged.select(*names, "action").unionByName(untouched.select(*names).withColumn("action", F.lit("kept")))


def _complete(on: list[str]) -> Column:
    given = F.lit(True)
    for c in on:
        given = given & F.col(c).isNotNull()
    return given


def insert_if_absent(new: DataFrame, existing: DataFrame, on: list[str], order: str = "id") -> DataFrame:
    """New rows as one insert after the other leaves them: a row whose key is stored, or came before, is left out.

    A null part makes a key unlike any other, so such rows are all inserted.
    """
    absent = new.join(existing.select(*on).distinct(), on, "left_anti")
    firsts = first_per_key(absent.filter(_complete(on)), on, [F.asc_nulls_last(order)])
    return firsts.unionByName(absent.filter(~_complete(on)))


def seed_merge(existing: DataFrame, seeds: DataFrame, on: list[str], column: str, order: str = "id") -> DataFrame:
    """Stored rows and seeds as one seed after the other leaves them.

    A seed fills one empty column on every row with its key, stored or seeded before it; a seed without such a row is
    added. So of seeds with one complete key the first stays, and takes its empty column from the next that has it.
    """
    given = seeds.filter(filled(column).isNotNull() & _complete(on))
    first = given.groupBy(*on).agg(F.min_by(column, order).alias("_seed"))
    absent = insert_if_absent(seeds, existing, on, order)
    rows = existing.unionByName(absent.select(*existing.columns))
    value = F.coalesce(filled(column), F.col("_seed"), F.col(column))
    return rows.join(first, on, "left").withColumn(column, value).select(*existing.columns)


def upsert(target: DataFrame, changes: DataFrame, key: str, newest: str, patch: bool = False) -> DataFrame:
    """Latest version of each row; with ``patch`` every column has its newest value that is not null, stored ones last."""
    if not patch:
        latest = first_per_key(changes, [key], [F.desc_nulls_last(newest)])
        both = target.withColumn("_side", F.lit(0)).unionByName(latest.withColumn("_side", F.lit(1)))
        return first_per_key(both, [key], [F.desc("_side"), F.desc_nulls_last(newest)]).drop("_side")
    rest = [n for n in target.columns if n != key]
    values = [F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(newest, n))).alias(n) for n in rest]
    t, c = target.alias("t"), changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*values).alias("c")
    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"c.{n}"), F.col(f"t.{n}")).alias(n) for n in target.columns])


def fill_if_missing(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column from ``updates`` (one row per key) only where it holds no text yet."""
    offered = updates.select(F.col(key), F.col(column).alias("_offer"))
    joined = df.join(offered, key, "left")
    value = F.when(has_text(column), F.col(column)).otherwise(F.coalesce(F.col("_offer"), F.col(column)))
    return joined.withColumn(column, value).select(*df.columns)


def backfill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Blank or null values become the default; running it twice changes nothing."""
    out = df
    for name, default in defaults.items():
        value = default if isinstance(default, Column) else F.lit(default)
        c = F.col(name)
        kept = F.when(has_text(c), c) if dict(df.dtypes)[name] == "string" else c
        out = out.withColumn(name, F.coalesce(kept, value))
    return out


def toggle(members: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Every change removes a present member or adds an absent one, so an even number of them changes nothing."""
    m = members.select(*keys).distinct().withColumn("_in", F.lit(1))
    counted = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_flip"))
    c = counted.filter("_flip % 2 = 1")
    both = m.join(c, keys, "full_outer")
    return both.filter(F.col("_in").isNull() | F.col("_flip").isNull()).select(*keys)


def membership(items: DataFrame, members: DataFrame, keys: list[str], name: str = "is_member") -> DataFrame:
    flags = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return items.join(flags, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
