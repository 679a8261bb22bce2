"""Predicates of the archive's queries.

Search predicates map a text value to a Column, so they fold into one filter that Catalyst splits and pushes
into the scans. ``SEARCH`` is the extension point: add a name and a function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.functions.text import like_pattern, normal_patient_id

# Accepted search text and dates.
ASCII_VALUE = r"^[a-zA-Z0-9-_<>\s%]+$"
DATE_VALUE = r"^(19|20|21)\d\d-(0[1-9]|1[012])-(0[1-9]|[12][0-9]|3[01])"
FORM_TEXT = r"^[/\s\.\-/0-9a-zA-Z]*$"
FORM_DATE = r"^(19|20|21)\d\d-(0[1-9]|1[012])-(0[1-9]|[12][0-9]|3[01])$"
FORM_INTEGER = r"^\d+$"
DAYS_PER_YEAR = 365.25


def _ascii(value: str) -> str:
    if not re.match(ASCII_VALUE, value):
        raise ValueError(f"{value!r} holds characters search does not accept")
    return value


def _date(value: str) -> str:
    if not re.match(DATE_VALUE, value):
        raise ValueError(f"{value!r} is not a date")
    return value


def by_psd(pattern: str, column: str = "epoch_psd") -> Column:
    return F.col(column).ilike(_ascii(pattern))


def by_scan_type(pattern: str, column: str = "epoch_scan_type") -> Column:
    return F.col(column).ilike(pattern)


def by_subject_name(pattern: str, first: str = "subject_firstname", last: str = "subject_lastname") -> Column:
    pattern = _ascii(pattern)
    return F.col(last).ilike(pattern) | F.col(first).ilike(pattern)


def by_exam(value: str, column: str = "session_exam") -> Column:
    return F.col(column) == int(value)


def by_operator(users: DataFrame, uid: str, sessions: DataFrame, column: str = "session_operator_id") -> DataFrame:
    """Sessions run by ``uid``; an unknown uid selects the sessions without an operator."""
    operator = users.where(F.col("uid") == _ascii(uid)).agg(F.max("id")).scalar()
    return sessions.where(F.col(column).eqNullSafe(operator))


def date_from(value: str, column: str = "session_timestamp") -> Column:
    return F.col(column) >= F.lit(_date(value)).cast("timestamp_ntz")


def date_to(value: str, column: str = "session_timestamp") -> Column:
    return F.col(column) <= F.lit(_date(value) + " 23:59:59").cast("timestamp_ntz")


def _age(timestamp: str, dob: str) -> Column:
    return F.col(timestamp) - F.col(dob).cast("timestamp_ntz")


def age_min(value: str, timestamp: str = "session_timestamp", dob: str = "subject_dob") -> Column:
    return _age(timestamp, dob) >= F.lit(timedelta(days=float(value) * DAYS_PER_YEAR))


def age_max(value: str, timestamp: str = "session_timestamp", dob: str = "subject_dob") -> Column:
    """A whole number includes the year after that birthday; a decimal number is exact."""
    years = float(value) + (0 if "." in value else 1)
    return _age(timestamp, dob) <= F.lit(timedelta(days=years * DAYS_PER_YEAR))


#: Search field -> (catalog level its columns come from, predicate). The operator field needs a lookup.
SEARCH: dict[str, tuple[str, Callable[[str], Column]]] = {
    "subject_firstname": ("subject", by_subject_name),
    "subject_lastname": ("subject", by_subject_name),
    "search_exam": ("session", by_exam),
    "search_age_min": ("age", age_min),
    "search_age_max": ("age", age_max),
    "search_psdname": ("epoch", by_psd),
    "search_scantype": ("epoch", by_scan_type),
    "date_from": ("session", date_from),
    "date_to": ("session", date_to),
}
REQUIRED = ("search_age_min", "search_age_max", "search_exam", "search_scantype", "search_operator",
            "search_psdname", "date_from", "date_to")


def validate_requests(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Check a table of search requests; adds ``valid`` and ``errors``.

    NULL means the field was not sent, an empty string that it was sent empty. ``is_superuser`` lets name
    fields go together with ``search_all``. ``strict`` applies the tighter rules of the entry form.
    """
    sent = lambda c: F.col(c).isNotNull()
    names = sent("subject_firstname") | sent("subject_lastname")
    both = sent("subject_firstname") & sent("subject_lastname")
    everywhere = F.coalesce(F.col("search_all"), F.lit(False))
    contract = F.lit(True)
    for name in REQUIRED:
        contract = contract & sent(name)
    contract = contract & (both | everywhere) & ~(names & everywhere & ~F.col("is_superuser"))
    fields = [*REQUIRED, "subject_firstname", "subject_lastname"]
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    empty = F.lit(True)
    for name in fields:
        empty = empty & ~filled(name)
    rules = {name: FORM_TEXT if strict else ASCII_VALUE
             for name in ("search_operator", "search_psdname", "subject_firstname", "subject_lastname")}
    rules |= {name: FORM_DATE if strict else DATE_VALUE for name in ("date_from", "date_to")}
    rules |= {"search_exam": FORM_INTEGER if strict else r"^\s*[+-]?\d+\s*$"}
    rules |= {name: FORM_INTEGER if strict else r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
              for name in ("search_age_min", "search_age_max")}
    errors = [F.when(~contract, "contract"), F.when(contract & empty, "empty_fields")]
    errors += [F.when(contract & filled(name) & ~F.col(name).rlike(rule), name) for name, rule in sorted(rules.items())]
    listed = F.concat_ws(",", *errors)
    return requests.withColumn("errors", listed).withColumn("valid", listed == "")


LIVE, ALL, TRASH = 0, 1, 2


def visible(df: DataFrame, mode: int = LIVE, column: str = "trashtime") -> DataFrame:
    """Soft-delete view: live rows, all rows, or trashed rows only."""
    if mode == LIVE:
        return df.where(F.col(column).isNull())
    return df.where(F.col(column).isNotNull()) if mode == TRASH else df


def min_access(df: DataFrame, level: int, column: str = "privilege") -> DataFrame:
    return df.where(F.col(column) >= level)


def by_kind(df: DataFrame, raw: bool, column: str = "kind") -> DataFrame:
    """With raw data: everything but viewer files; otherwise peripheral and derived data."""
    return df.where(F.col(column) != "web" if raw else F.col(column).isin("peripheral", "derived"))


def hide_raw(df: DataFrame, column: str = "kind") -> DataFrame:
    return df.where(F.col(column).isin("peripheral", "derived", "qa"))


def by_ids(df: DataFrame, ids: Sequence[int] | DataFrame, column: str = "id") -> DataFrame:
    """Restrict to a literal id list, or to the ids of a frame."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(*ids))


def cooled(containers: DataFrame, datasets: DataFrame, now, cool_seconds: float) -> DataFrame:
    """Dirty containers none of whose datasets was updated within the cool-down before ``now``."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(cool_seconds))
    warm = datasets.where(F.col("updatetime") > cutoff).select(F.col("container_id").alias("id"))
    return containers.where("dirty").join(warm, "id", "left_anti")


def jobs_where(jobs: DataFrame, statuses: Sequence[str] | None = None, task: str | None = None,
               needs_rerun: bool | None = None) -> DataFrame:
    if statuses is not None:
        jobs = jobs.where(F.col("status").isin(*statuses))
    if task is not None:
        jobs = jobs.where(F.col("task") == task)
    if needs_rerun is not None:
        jobs = jobs.where(F.col("needs_rerun") == needs_rerun)
    return jobs


def where_expr(df: DataFrame, *texts: str) -> DataFrame:
    """Caller-supplied SQL predicates, all of which must hold."""
    for text in texts:
        df = df.where(F.expr(text))
    return df


def not_discarded(df: DataFrame, discard_ids: Sequence[str], column: str = "patient_id") -> DataFrame:
    return df.where(~normal_patient_id(column).isin(*discard_ids)) if discard_ids else df


def by_patient_glob(df: DataFrame, glob: str, column: str = "patient_id") -> DataFrame:
    """``*`` matches anything; the rest is a pattern matched at the start of the id."""
    return df.where(F.col(column).rlike("^(?:" + glob.replace("*", ".*") + ")"))


def purge_after(catalog: Catalog, when) -> Catalog:
    """Drop epochs and sessions newer than ``when`` and everything below them (and those sessions' subjects)."""
    newer = lambda df: df.where(F.col("timestamp") > F.lit(when).cast("timestamp_ntz"))
    new_sessions = newer(catalog.session)
    subjects = new_sessions.select(F.col("subject_id").alias("id")).distinct()
    # ids met twice change nothing below, and telling them apart would hold them all in memory
    sessions = new_sessions.select("id").unionByName(
        catalog.session.join(subjects.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").select("id"))
    epochs = newer(catalog.epoch).select("id").unionByName(
        catalog.epoch.join(sessions.withColumnRenamed("id", "session_id"), "session_id", "left_semi").select("id"))
    return catalog.replace(
        subject=catalog.subject.join(subjects, "id", "left_anti"),
        session=catalog.session.join(sessions, "id", "left_anti"),
        epoch=catalog.epoch.join(epochs, "id", "left_anti"),
        dataset=catalog.dataset.join(epochs.withColumnRenamed("id", "container_id"), "container_id", "left_anti"))


def scope_epochs(catalog: Catalog, match: str = "", session_id: int | None = None, exam: int | None = None,
                 experiment_id: int | None = None, scan_type: str | None = None) -> DataFrame:
    """Epoch ids a batch job works on: description text within one session, exam or experiment."""
    where = {}
    epoch = F.contains(F.col("epoch_description"), F.lit(match)) if match else F.lit(True)
    if scan_type is not None:
        epoch = epoch & (F.col("epoch_scan_type") == scan_type)
    where["epoch"] = epoch
    if session_id is not None:
        where["session"] = F.col("session_id") == session_id
    elif exam is not None:
        where["session"] = F.col("session_exam") == exam
    if experiment_id is not None:
        where["subject"] = F.col("experiment_id") == experiment_id
        return catalog.chain("epoch", "subject", where).select("epoch_id")
    return catalog.chain("epoch", "session", where).select("epoch_id")


def qa_candidates(epochs: DataFrame, datasets: DataFrame, scan_type: str = "functional") -> DataFrame:
    """Live epochs of a scan type that wait for a QA report and have image data."""
    images = datasets.where("filetype = 'nifti'").select(F.col("container_id").alias("id"))
    waiting = epochs.where(F.col("qa_status").isin("pending", "rerun") & (F.col("scan_type") == scan_type)
                           & F.col("trashtime").isNull())
    return waiting.join(images, "id", "left_semi")


def nondiffusion(df: DataFrame, num_vols: int, index: str = "i", bval: str = "bval") -> DataFrame:
    return df.where((F.col(bval) < 10) & (F.col(index) < num_vols))


def validate_edits(catalog: Catalog, edits: DataFrame) -> DataFrame:
    """Flag edits that would break uniqueness.

    ``edits``: edit_id, session_id, subject_id, subject_code, uid, experiment_name, owner_gid; NULL columns are
    not checked. Adds ``error``: parseerr, exists (subject code), doesntexist (user), experiment_exists.
    """
    place = catalog.session.select(F.col("id").alias("session_id"), F.col("subject_id").alias("_sid")).join(
        catalog.subject.select(F.col("id").alias("_sid"), F.col("experiment_id").alias("_exp")), "_sid").drop("_sid")
    codes = catalog.subject.groupBy(F.col("experiment_id").alias("_exp"), F.col("code").alias("subject_code")).agg(
        F.min("id").alias("_holder"))
    names = catalog.experiment.join(
        catalog.research_group.select(F.col("id").alias("owner_id"), "gid"), "owner_id").select(
        F.col("name").alias("experiment_name"), F.col("gid").alias("owner_gid")).distinct().withColumn("_taken", F.lit(True))
    people = catalog.user.select("uid").distinct().withColumn("_user", F.lit(True))
    joined = (edits.join(place, "session_id", "left").join(codes, ["_exp", "subject_code"], "left")
              .join(people, "uid", "left").join(names, ["experiment_name", "owner_gid"], "left"))
    error = (F.when(F.col("session_id").isNotNull() & F.col("_exp").isNull(), "parseerr")
             .when(F.col("_holder") != F.col("subject_id"), "exists")
             .when(F.col("uid").isNotNull() & F.col("_user").isNull(), "doesntexist")
             .when(F.col("_taken"), "experiment_exists"))
    return joined.withColumn("error", error).drop("_exp", "_holder", "_user", "_taken")


def star_to_percent(value: str) -> str:
    """Optional reading of ``*`` as a wildcard in pattern values."""
    return like_pattern(value, star_wildcard=True)
