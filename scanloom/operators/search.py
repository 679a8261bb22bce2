"""Multi-criteria search over epochs with row-level security."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.operators.access import ANON, READ, granted
from scanloom.operators.filters import ALL, LIVE, REQUIRED, SEARCH, by_operator, star_to_percent


class SearchError(ValueError):
    """A request that search refuses, with the reason."""


def check_request(request: Mapping[str, str], superuser: bool = False) -> dict[str, str]:
    """Parameter contract; returns the non-empty criteria."""
    named = "subject_firstname" in request or "subject_lastname" in request
    both = "subject_firstname" in request and "subject_lastname" in request
    everywhere = "search_all" in request
    if not all(name in request for name in REQUIRED) or not (both or everywhere) or (
            named and everywhere and not superuser):
        raise SearchError("contract")
    criteria = {k: v for k, v in request.items() if v and k != "search_all"}
    if not criteria:
        raise SearchError("empty_fields")
    return criteria


def search_epochs(catalog: Catalog, user_id: int, request: Mapping[str, str], superuser: bool = False,
                  visibility: int = ALL, star_wildcard: bool = False) -> DataFrame:
    """Epochs matching every filled field: group, experiment, time, exam, scan type, description.

    Sending the name fields, even empty, asks for Read-Only access; otherwise Anon-Read is enough.
    ``search_all`` skips security. Each predicate is applied at its own level before the levels are joined,
    starting from the permitted experiments.
    """
    criteria = check_request(request, superuser)
    where, age = {}, []
    for name, value in criteria.items():
        if name == "search_operator":
            continue
        if name not in SEARCH:
            raise SearchError(f"unknown field {name}")
        place, predicate = SEARCH[name]
        try:
            column = predicate(star_to_percent(value) if star_wildcard else value)
        except ValueError as reason:
            raise SearchError(f"field {name} = {value!r} could not be processed: {reason}") from reason
        if place == "age":
            age.append(column)
        else:
            where[place] = where[place] & column if place in where else column
    if visibility != ALL:
        trash = F.col("epoch_trashtime")
        shown = trash.isNull() if visibility == LIVE else trash.isNotNull()
        where["epoch"] = where["epoch"] & shown if "epoch" in where else shown
    only = None
    if "search_all" not in request:
        named = "subject_firstname" in request or "subject_lastname" in request
        only = granted(catalog, user_id, READ if named else ANON)
    people = catalog.chain("session", "research_group", where, only)
    for column in age:
        people = people.where(column)
    if criteria.get("search_operator"):
        people = by_operator(catalog.user, criteria["search_operator"], people)
    epochs = catalog.prefixed("epoch")
    if "epoch" in where:
        epochs = epochs.where(where["epoch"])
    return epochs.join(people, "session_id").select(
        F.col("research_group_gid").alias("group_gid"), F.col("experiment_name").alias("experiment"),
        F.date_format("epoch_timestamp", "yyyy-MM-dd HH:mm").alias("time"), F.col("session_exam").alias("exam"),
        F.col("epoch_scan_type").alias("scan_type"), F.col("epoch_description").alias("description"),
        F.concat(F.lit("epoch="), F.col("epoch_id").cast("string")).alias("row_id"))


def psd_choices(epochs: DataFrame) -> DataFrame:
    """Distinct pulse sequences in order, after an empty first choice."""
    blank = epochs.sparkSession.sql("select '' as psd, 0 as place")
    return (blank.unionAll(epochs.select("psd").distinct().withColumn("place", F.lit(1)))
            .orderBy("place", F.col("psd").asc_nulls_first()).select("place", "psd"))


def session_counts(catalog: Catalog, user_id: int) -> DataFrame:
    """One row: sessions the user can reach, all sessions, unfinished jobs."""
    mine = catalog.chain("session", "subject", only=None).join(granted(catalog, user_id), "experiment_id", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
    jobs = catalog.job.where(F.col("status").isin("pending", "running"))
    rows = count(mine, "accessible_sessions").unionAll(count(catalog.session, "all_sessions")).unionAll(
        count(jobs, "unfinished_jobs"))
    return rows.select("what", "n")
