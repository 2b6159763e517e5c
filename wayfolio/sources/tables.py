"""Table scans, schema conformance and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table; only the named columns are read from disk."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def available_columns(df: DataFrame, optional) -> list[str]:
    return [c for c in optional if c in df.columns]


def with_optional_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns a table lacks, as typed nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def conform(df: DataFrame, target: StructType, required: list[str]) -> DataFrame:
    """Keep what the target table knows; fail when a required column is missing on either side."""
    known = [f.name for f in target.fields]
    absent = [c for c in required if c not in df.columns or c not in known]
    if absent:
        raise ValueError(f"required columns missing: {', '.join(absent)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields if f.name in df.columns])


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a parquet table; Spark sizes and commits the files."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Sources of different shape under one schema; missing columns are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
