"""Session helpers: a tuned local session for tests, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "wayfolio", cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_local_workspace(spark)
    return spark


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def name_local_workspace(spark: SparkSession) -> None:
    """For a session in one process that names no folder: one of this machine. A cluster is left as it is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not named and (master == "local" or master.startswith("local[")):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfolio-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{workspace(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage, so a lost executor costs no rework."""
    workspace(df.sparkSession)
    return df.checkpoint(eager=True)


def balanced(scan: DataFrame, key: str) -> DataFrame:
    """Spread a plain scan over idle cores before CPU-heavy text work.

    A split holds rows only where a row group begins, so one large row group is one task however many splits its file has.
    Rows are counted per split (from the footers); only where they lie in too few splits they are moved. A table with many
    row groups keeps its splits and gets no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    held = scan.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count"), F.sum("count")).first()
    if (held[0] or 0) * cores <= 2 * (held[1] or 0):
        return scan
    return scan.repartition(max(cores, scan.rdd.getNumPartitions()), key)


def balanced_stream(source: DataFrame, key: str) -> DataFrame:
    """Spread each micro-batch of a file stream over the cores, by ``key``, before CPU-heavy work.

    A batch of few files holds few splits, and every step on the batch would go on with as few tasks.
    """
    return source.repartition(source.sparkSession.sparkContext.defaultParallelism, key)
