"""Shared helpers: staged tables in the shared folder, document identity, Arrow plumbing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import scratch_folder

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOWEST = -(2**63)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder all executors share; only a single-machine session without one gets a temporary folder."""
    context = spark.sparkContext
    if (spark.conf.get("spark.checkpoint.dir", None) is None and context._jsc.sc().getCheckpointDir().isEmpty()
            and context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scanloom-checkpoints-"))
    return scratch_folder(spark, label)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind the written table are not needed any more and are released with the job.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_key(doc_id: str = "doc_id") -> Column:
    """The id documents are ordered by; a null id comes before every other."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))


def text_tag(text: str = "text") -> Column:
    """23 bits that tell documents of the same id apart; rows equal in id and text are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 23) - 1))


def tail_bucket(doc_id: str = "doc_id", of: int = 10) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``step`` to each Arrow batch; nothing is kept between batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
    return df.mapInArrow(run, schema)


def by_groups(dealt: DataFrame, keys: list[str], step: Callable[[pa.Table], pa.RecordBatch], schema: str, block_bytes: int = 1 << 22) -> DataFrame:
    """Apply ``step`` to tables of about ``block_bytes`` that hold whole groups. ``dealt`` is partitioned and sorted by ``keys``.

    Many small groups make one call; a group is held whole, so its size must be bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < block_bytes:
                continue
            table = pa.Table.from_batches(held)
            edge = np.zeros(max(0, table.num_rows - 1), bool)
            for key in keys:
                column = table.column(key).to_numpy()
                edge |= column[1:] != column[:-1]
            edges = np.flatnonzero(edge) + 1
            if not len(edges):
                continue
            yield step(table.slice(0, int(edges[-1])))
            rest = table.slice(int(edges[-1])).combine_chunks()
            held, size = rest.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield step(table)
    return dealt.mapInArrow(run, schema)
