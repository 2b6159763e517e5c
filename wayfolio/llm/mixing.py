"""Mixing sources to target weights: random order per source, running word counts, cut at the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfolio.llm.common import (
    before_each, bucket_count, filled, key_bucket, random_key, ranked, space_words, stored,
)

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
_SOURCE = ["no_source", "source_key"]


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Adds ``target`` to rows (no_source, source_key, source_size), one per source.

    Sources in code point order, the null source last, take the weights in turn and share ``share`` times all words.
    A target stops at ``ceiling`` times its source; the excess goes to the others by weight, until none is above. Each
    round is one aggregate over the sources, and only its sums come to the driver.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = stored(ranked(sizes, _SOURCE, "place").withColumn("weight", weight.cast("long")).drop("place"), "sources")
    cap = F.col("source_size") * ceiling
    level, total = 0.0, None
    while True:
        full = cap < F.lit(level) * F.col("weight")
        words, spent, open_weight = rows.agg(
            F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        total = share * (words or 0)
        risen = (total - spent) / open_weight if open_weight else level
        if risen <= level:
            return rows.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))
        level = risen


def mix(docs: DataFrame, keep: list[str], identity: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """What a mix takes of each document.

    Returns one row per document: ``doc`` (a struct of the columns ``keep``, so no name can clash), ``size`` (words),
    ``source_size``, ``target`` (words wanted of the source) and ``taken`` (words taken of this document).

    A random key of the id orders each source. Keys are cut into equal ranges; a range's words are summed before rows
    move, prefix sums over ranges give each its start, and a window inside a range gives each row its own. Whole epochs
    of a source come first, the last one is cut at the exact word, so a source's ``taken`` sums to floor(target).

    * Null text has no words and nothing is taken of it. A null source is a source, the last in order.
    * Ties of keys (repeated ids) are ordered by size; equal rows are interchangeable. An empty table gives no rows.
    * A hot source is spread over its ranges; no task holds a source.
    """
    buckets = bucket_count(docs.count())
    rows = docs.select(
        F.struct(*keep).alias("doc"), F.col(source).isNull().alias("no_source"), filled(F.col(source)).alias("source_key"),
        space_words(F.col(text)).alias("size"), random_key(F.col(identity)).alias("key"),
    ).withColumn("bucket", key_bucket(F.col("key"), buckets))
    totals = stored(rows.groupBy(*_SOURCE, "bucket").agg(F.sum("size").alias("words")), "ranges")
    targets = source_targets(
        totals.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), weights, share, ceiling
    ).drop("weight")
    starts = stored(before_each(totals, _SOURCE, "bucket", "words", "start").drop("words").join(targets, _SOURCE), "starts")

    earlier = Window.partitionBy(*_SOURCE, "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    placed = rows.join(starts, [*_SOURCE, "bucket"]).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("start")))
    return placed.select("doc", "size", "source_size", "target", (epochs * F.col("size") + last).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space between kept as it is."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, identity: str = "doc_id", text: str = "text", source: str = "source",
                    length: str | None = "n_chars") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per epoch, the one at the cut with its first words.

    A column ``length`` gets the length of a text that was cut. Documents of which nothing is taken are absent, those
    without words too.
    """
    plan = mix(docs, docs.columns, identity, text, source).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))
    )
    rows = plan.select("doc", F.explode(copies).alias("cut"))
    cut = F.when(F.col("cut") == 0, F.col("doc")[text]).otherwise(first_words(F.col("doc")[text], F.col("cut")))
    chars = F.when(F.col("cut") == 0, F.col("doc")[length]).otherwise(F.char_length(cut)) if length in docs.columns else None
    changed = {text: cut, length: chars}
    return rows.select(*(changed.get(c, F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
