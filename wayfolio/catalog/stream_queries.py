"""Incremental ingest on a file stream."""

from __future__ import annotations


from pyspark.sql import functions as F

from wayfolio.catalog.join_queries import WALK_SQL
from wayfolio.catalog.registry import add
from wayfolio.plans.ingest import parse_elements, three_keys
from wayfolio.session import balanced_stream, scratch_path
from wayfolio.sources.json_rows import read_geo_elements
from wayfolio.streaming.place_stream import ingest_stream, progress_table


def _landed(t, files: int = 3) -> str:
    """Map elements landed as parquet files, a range of arrivals each, in one pass.

    A file source takes the oldest files first, so each range waits for the one before.
    """
    path = scratch_path(t.spark, "landed")
    ranged = stored(t("elements_json").repartitionByRange(files, "arrival").withColumn("_part", F.spark_partition_id()), t)
    for part in range(files):
        ranged.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(path)
    return path


def stored(df, t):
    path = scratch_path(t.spark, "ranged")
    df.write.partitionBy("_part").parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


def _run(t, files_per_batch: int = 1):
    spark = t.spark
    landed = _landed(t)
    store, progress, checkpoint = (scratch_path(spark, n) for n in ("store", "progress", "stream"))
    raw = (
        spark.readStream.schema(t("elements_json").schema).option("maxFilesPerTrigger", files_per_batch).parquet(landed)
    )
    parsed = parse_elements(read_geo_elements(balanced_stream(raw, "arrival")), t("targets"))
    query = ingest_stream(parsed, store, progress, checkpoint, three_keys())
    query.awaitTermination()
    return store, progress


add(
    "j1_ingest_stream",
    lambda t: t.spark.read.parquet(_run(t)[0]).select("arrival", "name", "city", "country", "external_id"),
    "elements_json targets",
    f"""WITH RECURSIVE {WALK_SQL}
SELECT arrival, name, city, country, external_id FROM keyed JOIN walk USING (n) WHERE taken""",
)
# The same counters, however many files a batch takes.
for _name, _files in (("j2_progress", 1), ("j2_progress_two_files", 2), ("j2_progress_one_batch", 3)):
    add(
        _name,
        lambda t, files=_files: progress_table(t.spark, _run(t, files)[1]).select(
            "target_id", "fetched", "valid", "skipped_unnamed", "skipped_generic", "skipped_no_coordinates", "duplicates", "candidates", "status"
        ),
        "elements_json targets",
        f"""WITH RECURSIVE {WALK_SQL}
SELECT target_id, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'candidate') AS valid,
  count(*) FILTER (WHERE outcome = 'unnamed') AS skipped_unnamed, count(*) FILTER (WHERE outcome = 'generic') AS skipped_generic,
  count(*) FILTER (WHERE outcome = 'no_coordinates') AS skipped_no_coordinates,
  count(*) FILTER (WHERE outcome = 'candidate' AND NOT taken) AS duplicates,
  count(*) FILTER (WHERE taken) AS candidates, 'completed' AS status
FROM parsed LEFT JOIN (SELECT arrival, taken FROM keyed JOIN walk USING (n)) USING (arrival) GROUP BY 1""",
    )
