"""What the operators of this subpackage share: texts, keys, stored steps and distributed running sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfolio.session import scratch_path

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Random keys are the first 15 hex digits of an MD5 sum, so SQL engines can repeat them.
KEY_RANGE = 16**15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, lost executors cost no rework."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty."""
    return F.translate(filled(text), UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Number of words, split at ASCII white space; null has none."""
    body = F.btrim(filled(text), F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE_RUN))).cast("long")


def remainder(identity: Column, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.encode(filled(identity), "UTF-8")), F.lit(divisor))


def random_key(identity: Column) -> Column:
    """Uniform integer below ``KEY_RANGE``, the same in every run."""
    return F.conv(F.substring(F.md5(F.encode(filled(identity), "UTF-8")), 1, 15), 16, 10).cast("long")


def key_bucket(key: Column, buckets: int) -> Column:
    """Equal-width range of a random key; monotone, so buckets in order are keys in order."""
    return F.floor(key.cast("double") * F.lit(buckets / KEY_RANGE)).cast("long")


def bucket_count(rows: int) -> int:
    """Ranges of about sqrt(rows) rows: neither a range nor the list of ranges outgrows a task."""
    return max(1, math.isqrt(rows))


def before_each(totals: DataFrame, group: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """Adds what the earlier buckets of the same group sum to. One row per (group, bucket) comes in."""
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position in the total order of ``order``, by range partitions and their sizes."""
    part = f"{name}_part"
    spread = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    sizes = spread.groupBy(part).agg(F.count("*").alias(f"{name}_n"))
    first = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(f"{name}_n").over(first), F.lit(0)).alias(f"{name}_from"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return spread.join(starts, part).withColumn(name, inside + F.col(f"{name}_from")).drop(part, f"{name}_from")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts reach Python workers in batches of at most ``rows`` rows, so that long texts fit beside each other."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
