"""Session settings this library relies on, and reliable (never machine-local) lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own session."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("scanloom")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, for intermediate tables and stream checkpoints."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = current.get()
    return f"{folder.rstrip('/')}/scanloom-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder the cluster names and read it back.

    Used where two consumers must see exactly the same partition numbering, also after an executor is
    lost. The folder comes from ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
