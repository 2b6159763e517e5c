"""The keys of a store that grows batch by batch, in runs that are merged as they become many.

A run holds the keys of consecutive batches, in folders by a hash of the key. Batch 0 to n - 1 are covered by at most
(FANOUT - 1) runs for each power of FANOUT below n, so a key is rewritten only once per power. Which runs exist follows from
the number of batches alone: nothing has to be listed, and a batch that is run again finds the state it found before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
BUCKETS = 16
SCHEMA = "_key string, bucket int"


def cover(batches: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """The runs, as (first, last) batch, that hold batches 0 to ``batches`` - 1: as long as they can be, longest first."""
    runs, first = [], 0
    while first < batches:
        length = 1
        while first + length * fanout <= batches and first % (length * fanout) == 0:
            length *= fanout
        runs.append((first, first + length - 1))
        first += length
    return runs


def merged_by(batches: int, fanout: int = FANOUT) -> tuple[tuple[int, int], list[tuple[int, int]]] | None:
    """The run that becomes due once ``batches`` are stored, and the runs it takes the place of."""
    if not batches:
        return None
    due, before = cover(batches, fanout)[-1], [*cover(batches - 1, fanout), (batches - 1, batches - 1)]
    return None if due in before else (due, [r for r in before if r[0] >= due[0]])


@dataclass(frozen=True)
class KeyRuns:
    """Key runs below ``path``; the number of folders must stay the same for the life of a store."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    fanout: int = FANOUT

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        folders = [self._folder(r) for r in runs]
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*folders).select("_key", "bucket")

    def _write(self, keys: DataFrame, run: tuple[int, int]) -> None:
        # Rebalancing joins small buckets into one task and parts large ones, by their measured sizes.
        spread = keys.hint("rebalance", "bucket")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(run))

    def add(self, keys: DataFrame, batch: int) -> None:
        """Store the distinct ``_key`` values of one batch; the same batch again replaces them."""
        self._write(keys.select("_key", self._bucket()), (batch, batch))

    def compact(self, batch: int) -> None:
        """Before batch ``batch``: merge the runs that are due, and drop those merged one batch earlier.

        What a merge read stays until the next batch begins, since the batch after a merge may be run again.
        """
        earlier = merged_by(batch - 1, self.fanout) if batch else None
        for run in earlier[1] if earlier else []:
            self._drop(run)
        due = merged_by(batch, self.fanout)
        if due:
            self._write(self._read(due[1]), due[0])

    def _drop(self, run: tuple[int, int]) -> None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._folder(run))
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def held(self, keys: DataFrame, batch: int) -> DataFrame | None:
        """Those of the distinct ``_key`` values that a batch before ``batch`` has stored; None where there is no batch yet.

        Only folders that the keys fall into are read. The stored keys are the streamed side of the join: a small batch is
        sent to them, they don't move.
        """
        runs = cover(batch, self.fanout)
        if not runs:
            return None
        asked = keys.select("_key", self._bucket())
        hit = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        stored = self._read(runs).filter(F.col("bucket").isin(hit))
        return stored.join(asked.select("_key"), "_key", "left_semi").select("_key")
