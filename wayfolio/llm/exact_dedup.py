"""Exact duplicates by two Bloom passes; only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from wayfolio.llm.common import ascii_lower, scratch_path, stored

#: Cells of one filter: 2**26 bits are at most 2**20 rows of 64 bits, the bound of what is broadcast.
MAX_CELLS = 2**26
CELLS_PER_ROW = 16


def _cells(sha: Column, cells: int) -> Column:
    """The two probes of a digest."""
    return F.array(*(F.pmod(F.xxhash64(sha, F.lit(probe)), F.lit(cells)) for probe in (1, 2)))


def _repeat_filter(hashes: DataFrame, cells: int) -> DataFrame:
    """First pass: the cells that were hit at least twice, as rows (word, bits) of 64 cells.

    Counts are combined on the map side; what moves is at most one (cell, count) per probe and task. Two equal
    hashes hit both their cells twice, so no repeated hash is missed.
    """
    hit = hashes.select(F.explode(_cells(F.col("sha"), cells)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell", F.lit(64)).cast("int"))
    return (
        hit.filter("n > 1")
        .groupBy(F.floor(F.col("cell") / 64).cast("long").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )


def _maybe_repeated(hashes: DataFrame, words: DataFrame, cells: int) -> DataFrame:
    """Second pass: probes the filter for every row, without moving rows."""
    out = hashes
    for probe in (1, 2):
        cell = F.pmod(F.xxhash64("sha", F.lit(probe)), F.lit(cells))
        side = F.broadcast(words.select(F.col("word").alias(f"w{probe}"), F.col("bits").alias(f"b{probe}")))
        out = out.withColumn("cell", cell).join(side, F.floor(F.col("cell") / 64).cast("long") == F.col(f"w{probe}"), "left")
        out = out.withColumn(
            f"set{probe}",
            F.coalesce(F.call_function("getbit", F.col(f"b{probe}"), F.pmod("cell", F.lit(64)).cast("int")) == 1, F.lit(False)),
        )
    return out.withColumn("maybe", F.col("set1") & F.col("set2")).drop("cell", "w1", "w2", "b1", "b2", "set1", "set2")


def exact_dedup(docs: DataFrame, identity: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays.

    * Null text is empty; all empty texts are one group. Long texts are hashed whole.
    * Of rows that repeat an id and a text exactly one is ``kept``. A null id is below every other id.
    * Other columns are not read, whatever their names. An empty table gives no rows.

    A filter has ``max_cells`` bits at most. Where the rows need more, hashes are dealt to segments by their own
    value, each with a filter of its own, and a stored segment is read only by its own pass.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.encode(ascii_lower(F.col(text)), "UTF-8"), 256)
    hashes = docs.select(
        F.col(identity).alias("doc_id"), digest.alias("sha"), F.monotonically_increasing_id().alias("row")
    )
    segments = max(1, -(-docs.count() * CELLS_PER_ROW // max_cells))
    path = scratch_path(spark, "hashes")
    dealt = hashes.withColumn("segment", F.pmod(F.xxhash64("sha", F.lit(0)), F.lit(segments)).cast("int"))
    dealt.write.partitionBy("segment").parquet(path)
    probed = scratch_path(spark, "probed")
    for segment in range(segments):
        own = spark.read.schema(dealt.schema).parquet(path).filter(F.col("segment") == segment).drop("segment")
        cells = min(max_cells, 1 << max(10, (own.count() * CELLS_PER_ROW).bit_length()))
        words = stored(_repeat_filter(own, cells), "filter")
        _maybe_repeated(own, words, cells).write.mode("append").parquet(probed)
    rows = spark.read.schema(T.StructType([*hashes.schema, T.StructField("maybe", T.BooleanType())])).parquet(probed)

    passed = rows.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    suspects = rows.filter("maybe").select("doc_id", "sha", "row")
    groups = stored(
        suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")), "groups"
    )
    settled = suspects.join(groups, "sha").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return passed.unionByName(settled)
