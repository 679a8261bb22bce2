"""Aggregates over the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import PARENT, Catalog
from scanloom.operators.ordering import chunked_lists, row_numbers


def code_number(column: str = "code"):
    """Digits of a subject code as a number; 0 without digits."""
    return F.concat(F.lit("0"), F.regexp_replace(F.col(column), "[^0-9]+", "")).cast("long")


def next_subject_codes(subjects: DataFrame, experiments: DataFrame) -> DataFrame:
    """Next free ``s%03d`` code of every experiment."""
    used = subjects.groupBy("experiment_id").agg(F.max(code_number()).alias("used"))
    every = experiments.select(F.col("id").alias("experiment_id")).join(used, "experiment_id", "left")
    number = F.coalesce("used", F.lit(0)) + 1
    return every.select("experiment_id", number.alias("number"), F.format_string("s%03d", number).alias("code"))


def session_start(sessions: DataFrame, epochs: DataFrame) -> DataFrame:
    """Sessions with their time moved to their earliest epoch when that is earlier or the time is unset."""
    first = epochs.groupBy("session_id").agg(F.min("timestamp").alias("_first")).withColumnRenamed("session_id", "id")
    return sessions.join(first, "id", "left").withColumn("timestamp", F.least("timestamp", "_first")).drop("_first")


def contains_trash(catalog: Catalog, top: str = "experiment") -> dict[str, DataFrame]:
    """Per level (id, contains_trash): the row or anything below it is trashed. Rolled up bottom-up."""
    flags: dict[str, DataFrame] = {}
    below = None
    for level in ("dataset", "epoch", "session", "subject", "experiment"):
        own = catalog.frames[level].select("*", F.col("trashtime").isNotNull().alias("_own"))
        if below is not None:
            own = own.join(below, "id", "left")
            own = own.withColumn("_own", F.col("_own") | F.coalesce("_below", F.lit(False)))
        flags[level] = own.select("id", F.col("_own").alias("contains_trash"))
        if level == top:
            break
        below = own.groupBy(F.col(PARENT[level][0]).alias("id")).agg(F.bool_or("_own").alias("_below"))
    return flags


def renumber_subjects(subjects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Codes ``s001`` … per experiment by first session time; subjects without sessions come last.

    Only keys are numbered (and written for it); whole rows meet their new code once, on the id.
    """
    first = sessions.groupBy(F.col("subject_id").alias("id")).agg(F.min("timestamp").alias("_first"))
    keys = subjects.select("id", "experiment_id").join(first, "id", "left").withColumn("_none", F.col("_first").isNull())
    numbered = row_numbers(keys, ["experiment_id"], ["_none", "_first", "id"], "_n").select("id", F.format_string("s%03d", "_n").alias("_code"))
    return subjects.join(numbered, "id").withColumn("code", F.col("_code")).select(*subjects.columns)


def primary_datasets(datasets: DataFrame) -> DataFrame:
    """The primary dataset of every container (lowest id)."""
    return datasets.where("kind = 'primary'").groupBy("container_id").agg(F.min("id").alias("dataset_id"))


def original_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.col("kind").isin("primary", "secondary"))


def acquisition_files(files: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Raw files (exam, series, acq, path) grouped into acquisitions, in bounded lists."""
    return chunked_lists(files, ["exam", "series", "acq"], ["path"], "path", "paths", chunk)


def recording_files(files: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Physio files (ts, name) of one recording time, in bounded lists."""
    return chunked_lists(files, ["ts"], ["name"], "name", "names", chunk)
