"""Exactly-once ingest of parsed records into versioned catalog snapshots (``foreachBatch``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.operators.ingest import ingest
from scanloom.sources.readers import split_dead_letters

CHANGED = ("experiment", "access", "subject", "session", "epoch", "dataset")


class IngestSink:
    """Applies each micro-batch to the latest snapshot and writes the next one.

    A snapshot is a folder named after its batch; a marker file is written last. A repeated batch finds its
    marker and does nothing, an interrupted one is overwritten. Unparsable records go to a dead-letter folder
    per batch. Tables that ingest does not change come from ``fixed``.
    """

    def __init__(self, path: str, fixed: Catalog, initial: Catalog, now, parsed: Column | None = None):
        self.path, self.fixed, self.initial, self.now = path, fixed, initial, now
        self.parsed = F.col("patient_id").isNotNull() if parsed is None else parsed

    def _exists(self, spark: SparkSession, path: str) -> bool:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def snapshot(self, spark: SparkSession, batch_id: int) -> Catalog:
        """State after ``batch_id``, or the initial state."""
        version = batch_id
        while version >= 0:
            if self._exists(spark, f"{self.path}/state/{version}/done"):
                frames = {n: spark.read.parquet(f"{self.path}/state/{version}/{n}") for n in CHANGED}
                return self.fixed.replace(**frames)
            version -= 1
        return self.fixed.replace(**{n: self.initial.frames[n] for n in CHANGED})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{self.path}/state/{batch_id}"
        if self._exists(spark, f"{folder}/done"):
            return
        good, bad = split_dead_letters(batch, self.parsed, "source")
        bad.write.mode("overwrite").parquet(f"{self.path}/dead/{batch_id}")
        after = ingest(self.snapshot(spark, batch_id - 1), good, self.now)
        for name in CHANGED:
            after.frames[name].write.mode("overwrite").parquet(f"{folder}/{name}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/done")
