"""Incremental, restart-safe place ingest on a file stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.operators.aggregates import ingest_stats
from wayfolio.operators.dedupe import accepted_rows, claimed_keys, dedupe_incoming
from wayfolio.session import materialize
from wayfolio.streaming.key_runs import KeyRuns


ERROR_LENGTH = 500


def write_batch(df: DataFrame, path: str, batch_id: int | str) -> None:
    """Replace the folder of one batch, so a retry leaves the same rows as a first run."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def progress_rows(tagged: DataFrame, batch_id: int, target: str = "target_id") -> DataFrame:
    """Counters per target of one batch, as a progress state."""
    return ingest_stats(tagged, target).withColumns({
        "status": F.lit("completed"), "last_error": F.lit(None).cast("string"), "last_batch": F.lit(batch_id).cast("bigint"),
    })


def state_rows(batch: DataFrame, batch_id: int, status: str, error: str | None = None, target: str = "target_id") -> DataFrame:
    """The targets of a batch that is ``running`` or ``failed``, with nothing counted yet."""
    counters = ingest_stats(batch.select(target, "outcome"), target)
    zero = {c: F.lit(0).cast("bigint") for c in counters.columns if c != target}
    return counters.withColumns({
        **zero, "status": F.lit(status), "last_error": F.lit(error).cast("string"), "last_batch": F.lit(batch_id).cast("bigint"),
    })


def progress_table(spark, path: str, target: str = "target_id") -> DataFrame:
    """Current progress of every target: its counters over all batches, its latest state and its last error.

    A target whose latest batch is done after one that broke is ``completed_with_errors``.
    """
    rows = spark.read.parquet(path).drop("batch_id")
    state = ("status", "last_error", "last_batch")
    summed = rows.groupBy(target).agg(
        *(F.sum(c).alias(c) for c in rows.columns if c not in (target, *state)),
        F.max_by("status", F.struct("last_batch", F.array_position(F.lit(["running", "failed", "completed"]), F.col("status")))).alias("status"),
        F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("last_batch"))).alias("last_error"),
        F.max("last_batch").alias("last_batch"),
    )
    mended = (F.col("status") == "completed") & F.col("last_error").isNotNull()
    return summed.withColumn("status", F.when(mended, F.lit("completed_with_errors")).otherwise(F.col("status")))


def ingest_stream(
    source: DataFrame, store: str, progress: str, checkpoint: str, keys: dict[str, Column],
    seed: DataFrame | None = None, target: str = "target_id",
):
    """Run a stream of parsed places to the end of the available input.

    Each micro-batch is deduplicated against everything stored so far (and against ``seed``),
    its new rows are stored, their keys go to runs beside the store (``<store>_keys``, see ``key_runs``),
    and its counters are recorded. The parsed batch is stored first, so it is parsed once. Before, the batch's targets are marked ``running``; a batch that breaks leaves them
    ``failed`` with the error, beside the counters its later run writes. The stream's checkpoint remembers which input was consumed;
    all sinks are written per batch id, so replays change nothing.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        runs = KeyRuns(batch.sparkSession, f"{store}_keys")
        runs.compact(batch_id)
        ready = batch.filter("outcome = 'candidate'").drop("outcome")
        claimed = runs.held(claimed_keys(ready, keys), batch_id)
        tagged = materialize(dedupe_incoming(ready, seed, keys, claimed=claimed))
        taken = accepted_rows(tagged)
        runs.add(claimed_keys(taken, keys), batch_id)
        write_batch(taken, store, batch_id)
        rejected = batch.filter("outcome <> 'candidate'").select(target, "outcome")
        write_batch(progress_rows(tagged.select(target, "outcome").unionByName(rejected), batch_id, target), progress, batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch)
        write_batch(state_rows(batch, batch_id, "running", target=target), progress, batch_id)
        try:
            take(batch, batch_id)
        except Exception as error:
            said = f"{type(error).__name__}: {error}"[:ERROR_LENGTH]
            write_batch(state_rows(batch, batch_id, "failed", said, target), progress, f"{batch_id}-failed")
            raise

    return (
        source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
