"""Upsert of parsed scan records through the catalog hierarchy, as set operations in arrival order.

Keys: dataset (series uid, acquisition, filetype), epoch (series uid, acquisition), session (exam uid), subject
(code, or names and birth date, inside an experiment), experiment (group, name). The first record of a new key
creates the row; surrogate ids continue the highest one in arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.functions.names import default_label, end_of_day
from scanloom.functions.text import clean_string, patient_id_parts
from scanloom.operators.access import default_grants
from scanloom.operators.matching import match_labs
from scanloom.operators.ordering import row_numbers, running_total
from scanloom.operators.rollup import code_number
from scanloom.operators.state import _ascend, mark_dirty
from scanloom.session import cut_lineage


def normalize(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Resolve patient ids to group, experiment and subject code; move screenshots to the end of their day.

    Each distinct patient id is parsed once and matched, then records meet their id: a lab may own most of them.
    Parsed ids are written out, so filters on their parts do not parse every record at the scan.
    """
    parsed = records.select(F.col("patient_id").alias("_patient")).distinct().withColumn("_p", patient_id_parts("_patient")).select(
        "_patient", F.col("_p.subj_code").alias("subj_code"), F.col("_p.lab_id").alias("lab_id"), F.col("_p.exp_id").alias("_exp"))
    parsed = cut_lineage(parsed)
    resolved = parsed.join(match_labs(parsed, groups), "lab_id", "left")
    known = records.join(resolved, F.col("patient_id").eqNullSafe(F.col("_patient")), "left")
    shot = F.coalesce(F.col("is_screenshot"), F.lit(False))
    return (known.withColumn("group_gid", F.coalesce("gid", F.lit("unknown")))
            .withColumn("exp_name", F.when(F.col("gid").isNull(), F.col("patient_id")).otherwise(F.col("_exp")))
            .withColumn("acq_no", F.when(shot, 0).otherwise(F.col("acq_no")))
            .withColumn("timestamp", F.when(shot, end_of_day("timestamp")).otherwise(F.col("timestamp")))
            .drop("_patient", "_exp", "lab_id", "gid"))


def first_arrivals(records: DataFrame, keys: list[str]) -> DataFrame:
    """First record of every key, combined before the shuffle. NULL acquisitions are one key value."""
    fields = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.min_by(F.struct(*fields), "arrival_seq").alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in fields])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _absent(records: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return records.join(stored, _same(records, stored, keys), "left_anti")


def _next_ids(new: DataFrame, stored: DataFrame, name: str) -> DataFrame:
    """Continue the surrogate keys of ``stored`` in arrival order."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return row_numbers(new, [], ["arrival_seq"], "_k").withColumn(name, F.col("_k") + top).drop("_k")


def _fill(rows: DataFrame, like: DataFrame, values: dict[str, Column]) -> DataFrame:
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def arbitrate(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Kind of every new dataset of an epoch, and which earlier primaries it displaces.

    ``new``: series_uid, acq_no, filetype, arrival_seq, priority — one row per new filetype, so a group has at
    most as many rows as there are filetypes. ``stored``: series_uid, acq_no, dataset_id, priority of the present
    primary. A newcomer is primary when there is none or its priority is strictly higher. Adds ``kind`` and
    ``displaced`` (the stored primary loses its place) per new row.
    """
    present = stored.select(F.col("series_uid").alias("_u"), F.col("acq_no").alias("_a"), F.col("priority").alias("_p"))
    seen = new.join(present, new.series_uid.eqNullSafe(F.col("_u")) & new.acq_no.eqNullSafe(F.col("_a")), "left")
    arrived = Window.partitionBy("series_uid", "acq_no").orderBy("arrival_seq")
    before = F.greatest("_p", F.max("priority").over(arrived.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.row_number().over(arrived) == 1
    wins = seen.withColumn("_wins", (F.col("_p").isNull() & first) | F.coalesce(before < F.col("priority"), F.lit(False)))
    later = F.max(F.when(F.col("_wins"), 1)).over(arrived.rowsBetween(1, Window.unboundedFollowing))
    rerun = F.max(F.when(F.col("_wins") & (F.col("_p").isNotNull() | ~first), 1)).over(
        Window.partitionBy("series_uid", "acq_no"))
    any_win = F.max(F.when(F.col("_wins"), 1)).over(Window.partitionBy("series_uid", "acq_no"))
    return (wins.withColumn("kind", F.when(F.col("_wins") & later.isNull(), "primary").otherwise("secondary"))
            .withColumn("displaced", F.col("_p").isNotNull() & any_win.isNotNull())
            .withColumn("rerun", rerun.isNotNull()).drop("_u", "_a", "_p", "_wins"))


def _subjects(catalog: Catalog, fresh: DataFrame, experiments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subject of every new session, creating subjects where needed: (exam_uid -> subject_id, new subjects)."""
    stored = catalog.subject
    place = experiments.select(F.col("id").alias("experiment_id"), F.col("name").alias("exp_name"), "owner_id").join(
        catalog.research_group.select(F.col("id").alias("owner_id"), F.col("gid").alias("group_gid")), "owner_id").drop("owner_id")
    asks = fresh.join(place, ["group_gid", "exp_name"])
    has_names = (F.coalesce("subj_firstname", F.lit("")) != "") & (F.coalesce("subj_lastname", F.lit("")) != "")
    asks = asks.withColumn("how", F.when(F.col("subj_code") != "", "code").when(has_names, "name").otherwise("none"))
    by_code = stored.groupBy("experiment_id", F.col("code").alias("subj_code")).agg(F.min("id").alias("_by_code"))
    by_name = stored.groupBy("experiment_id", F.col("firstname").alias("subj_firstname"), F.col("lastname").alias("subj_lastname"),
                             "dob").agg(F.min("id").alias("name"))
    asks = asks.join(by_code, ["experiment_id", "subj_code"], "left")
    named = by_name.select(*[F.col(c).alias(f"_by_{c}") for c in by_name.columns])
    asks = asks.join(named, (F.col("experiment_id") == F.col("_by_experiment_id"))
                     & (F.col("subj_firstname") == F.col("_by_subj_firstname"))
                     & (F.col("subj_lastname") == F.col("_by_subj_lastname"))
                     & F.col("subj_dob").eqNullSafe(F.col("_by_dob")), "left")
    known = F.when(F.col("how") == "code", F.col("_by_code")).when(F.col("how") == "name", F.col("_by_name"))
    asks = asks.withColumn("_known", known).select(
        "exam_uid", "arrival_seq", "experiment_id", "how", "subj_code", "subj_firstname", "subj_lastname", "subj_dob", "_known")
    asks = cut_lineage(asks)
    new = asks.where("_known is null")
    # the creator of a coded subject is the first session with its code; an unnamed session creates its own
    coded = new.where("how = 'code'").groupBy("experiment_id", "subj_code").agg(F.min("arrival_seq").alias("_creator"))
    solo = new.where("how = 'none'").select("experiment_id", F.col("arrival_seq").alias("_creator"))
    name_key = ["experiment_id", "subj_firstname", "subj_lastname"]
    dob_text = F.coalesce(F.col("subj_dob").cast("string"), F.lit(""))
    full_key = [*name_key, "_dob_text"]
    new = new.withColumn("_dob_text", dob_text)
    coded_rows = new.where("how = 'code'").join(coded, ["experiment_id", "subj_code"]).where(
        F.col("arrival_seq") == F.col("_creator")).select(*full_key, "arrival_seq")
    named = new.where("how = 'name'").select(*full_key, "arrival_seq")
    name_creator = coded_rows.unionByName(named).groupBy(*full_key).agg(F.min("arrival_seq").alias("_creator")).join(
        named.select(*full_key).distinct(), full_key, "left_semi")
    creators = coded.select("_creator").unionByName(name_creator.select("_creator")).unionByName(solo.select("_creator")).distinct()
    made = new.join(creators.withColumnRenamed("_creator", "arrival_seq"), "arrival_seq", "left_semi")
    # next free codes: every uncoded creation takes the running maximum of all earlier numbers plus one
    used = stored.groupBy("experiment_id").agg(F.max(code_number()).alias("_used"))
    seeds = made.join(used, "experiment_id", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    seeds = seeds.withColumn("_number", F.when(F.col("how") == "code", code_number("subj_code")))
    counted = running_total(seeds, ["experiment_id"], ["arrival_seq"], F.when(F.col("_number").isNull(), 1).otherwise(0), "_u")
    peak = running_total(counted, ["experiment_id"], ["arrival_seq"], F.greatest(F.col("_used"), F.col("_number") - F.col("_u")), "_m", how="max")
    code = F.when(F.col("how") == "code", F.substring("subj_code", 1, 31)).otherwise(
        F.format_string("s%03d", F.col("_u") + F.col("_m")))
    numbered = _next_ids(peak.withColumn("_code", code), stored, "_id")
    text = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 63)
    rows = _fill(numbered, stored, {
        "id": F.col("_id"), "code": F.col("_code"), "firstname": text("subj_firstname"), "lastname": text("subj_lastname"),
        "dob": F.col("subj_dob"), "experiment_id": F.col("experiment_id"), "person_id": F.col("_id")})
    ids = numbered.select(F.col("arrival_seq").alias("_creator"), "_id")
    linked = (new.join(coded.withColumnRenamed("_creator", "_c1"), ["experiment_id", "subj_code"], "left")
              .join(name_creator.withColumnRenamed("_creator", "_c2"), full_key, "left")
              .withColumn("_creator", F.when(F.col("how") == "code", F.col("_c1")).when(F.col("how") == "name", F.col("_c2"))
                          .otherwise(F.col("arrival_seq")))
              .join(ids, "_creator").select("exam_uid", F.col("_id").alias("subject_id")))
    return asks.where("_known is not null").select("exam_uid", F.col("_known").alias("subject_id")).unionByName(linked), rows


def ingest(catalog: Catalog, records: DataFrame, now) -> Catalog:
    """Apply a batch of parsed headers to the catalog.

    New rows appear at every level; kinds are arbitrated; every dataset that received a file gets its new file
    name and update time, is restored with its ancestors, and marks its epoch dirty. ``filename`` is optional.
    """
    ready = normalize(records, catalog.research_group)
    if "filename" not in ready.columns:
        ready = ready.withColumn("filename", F.lit(None).cast("string"))
    ready = cut_lineage(ready)  # matched once; every level below reads it
    epoch_key, data_key = ["series_uid", "acq_no"], ["series_uid", "acq_no", "filetype"]
    stored_epochs = catalog.epoch.select(F.col("uid").alias("series_uid"), F.col("acq").alias("acq_no"), F.col("id").alias("epoch_id"))
    stored_sessions = catalog.session.select(F.col("uid").alias("exam_uid"), F.col("id").alias("session_id"))
    new_epochs = cut_lineage(_absent(first_arrivals(ready, epoch_key), stored_epochs, epoch_key))
    new_sessions = cut_lineage(_absent(first_arrivals(new_epochs, ["exam_uid"]), stored_sessions, ["exam_uid"]))

    wanted = first_arrivals(new_sessions.select("group_gid", "exp_name", "arrival_seq"), ["group_gid", "exp_name"])
    owners = catalog.research_group.select(F.col("gid").alias("group_gid"), F.col("id").alias("owner_id"))
    wanted = wanted.join(owners, "group_gid")
    held = catalog.experiment.select("owner_id", F.col("name").alias("exp_name"))
    made = _next_ids(_absent(wanted, held, ["owner_id", "exp_name"]), catalog.experiment, "_id")
    new_experiments = _fill(made, catalog.experiment, {"id": F.col("_id"), "name": F.col("exp_name"), "owner_id": F.col("owner_id")})
    experiments = catalog.experiment.unionByName(new_experiments)
    grants = default_grants(catalog.group_role, new_experiments)
    access = catalog.access.unionByName(_fill(grants, catalog.access, {c: F.col(c) for c in grants.columns}))

    subject_of, new_subjects = _subjects(catalog, new_sessions, experiments)
    subject_of = cut_lineage(subject_of)
    users = catalog.user.groupBy(F.col("uid").alias("operator")).agg(F.min("id").alias("operator_id"))
    starts = new_epochs.groupBy("exam_uid").agg(F.min("timestamp").alias("_start"))
    born = _next_ids(new_sessions.join(subject_of, "exam_uid").join(users, "operator", "left").join(starts, "exam_uid", "left"),
                     catalog.session, "_id")
    session_rows = _fill(born, catalog.session, {
        "id": F.col("_id"), "uid": F.col("exam_uid"), "exam": F.coalesce("exam_no", F.lit(0)), "subject_id": F.col("subject_id"),
        "operator_id": F.col("operator_id"), "timestamp": F.col("_start")})
    earlier = catalog.session.join(starts.withColumnRenamed("exam_uid", "uid"), "uid", "left").withColumn(
        "timestamp", F.least("timestamp", "_start")).select(*catalog.session.columns)
    sessions = earlier.unionByName(session_rows)

    parent = sessions.select(F.col("uid").alias("exam_uid"), F.col("id").alias("session_id"))
    placed = _next_ids(new_epochs.join(parent, "exam_uid"), catalog.epoch, "_id")
    parameters = {f.name: F.col(f.name) for f in catalog.epoch.schema.fields if f.name in placed.columns}
    epoch_rows = _fill(placed, catalog.epoch, {
        **parameters, "id": F.col("_id"), "uid": F.col("series_uid"), "session_id": F.col("session_id"),
        "series": F.col("series_no"), "acq": F.col("acq_no"), "description": clean_string("series_desc"),
        "psd": F.col("psd_name"), "physio_recorded": F.lit(True), "qa_status": F.lit("pending"), "trashtime": F.lit(None),
        "num_timepoints": F.coalesce(F.col("num_timepoints"), F.lit(1)) if "num_timepoints" in placed.columns else F.lit(1),
        "dirty": F.lit(False), "scheduling": F.lit(False)})
    epochs = catalog.epoch.unionByName(epoch_rows)

    epoch_ids = epochs.select(F.col("uid").alias("series_uid"), F.col("acq").alias("acq_no"), F.col("id").alias("epoch_id"))
    stored_data = catalog.dataset.join(stored_epochs, F.col("container_id") == F.col("epoch_id")).select(
        "series_uid", "acq_no", "filetype", F.col("id").alias("dataset_id"), "kind", "priority")
    arrivals = _absent(first_arrivals(ready, data_key), stored_data, data_key)
    judged = arbitrate(arrivals, stored_data.where("kind = 'primary'"))
    held_at = judged.join(epoch_ids, _same(judged, epoch_ids, epoch_key)).drop(epoch_ids.series_uid).drop(epoch_ids.acq_no)
    born_data = _next_ids(held_at, catalog.dataset, "_id")
    data_rows = _fill(born_data, catalog.dataset, {
        "id": F.col("_id"), "container_id": F.col("epoch_id"), "label": default_label("filetype"), "kind": F.col("kind"),
        "filetype": F.col("filetype"), "priority": F.col("priority"), "archived": F.lit(True), "compressed": F.lit(False),
        "qa_status": F.lit("pending"), "datatype": F.lit("unknown"), "updatetime": F.lit(now)})
    demoted = held_at.where("displaced").select(F.col("epoch_id").alias("container_id")).distinct().withColumn("_lost", F.lit(True))
    kept = catalog.dataset.join(demoted, "container_id", "left").withColumn(
        "kind", F.when(F.col("_lost") & (F.col("kind") == "primary"), "secondary").otherwise(F.col("kind"))).select(*catalog.dataset.columns)
    reruns = held_at.where("rerun").select(F.col("epoch_id").alias("id")).distinct().withColumn("_again", F.lit(True))
    epochs = epochs.join(reruns, "id", "left").withColumn(
        "qa_status", F.when(F.col("_again"), "rerun").otherwise(F.col("qa_status"))).select(*catalog.epoch.columns)

    # what the batch delivered to each dataset
    last = ready.groupBy(*data_key).agg(F.max_by("filename", "arrival_seq").alias("_file"))
    touched = last.join(epoch_ids, _same(last, epoch_ids, epoch_key)).select(
        F.col("epoch_id").alias("container_id"), "filetype", "_file", F.lit(True).alias("_hit"))
    datasets = kept.unionByName(data_rows)
    fresh = datasets.join(touched, ["container_id", "filetype"], "left")
    file_value = F.when(F.col("_file").isNotNull(), F.array("_file")).otherwise(F.col("filenames"))
    datasets = (fresh.withColumn("filenames", file_value)
                .withColumn("updatetime", F.when(F.col("_hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updatetime")))
                .withColumn("trashtime", F.when(F.col("_hit").isNull(), F.col("trashtime"))).select(*catalog.dataset.columns))
    result = catalog.replace(experiment=experiments, access=access, subject=catalog.subject.unionByName(new_subjects),
                             session=sessions, epoch=mark_dirty(epochs, touched), dataset=datasets)
    woken = {}
    ids = touched.select(F.col("container_id").alias("id")).distinct()
    for name, found in {"epoch": ids, **_ascend(result, "epoch", ids)}.items():
        df = result.frames[name]
        woken[name] = df.join(found.withColumn("_up", F.lit(True)), "id", "left").withColumn(
            "trashtime", F.when(F.col("_up").isNull(), F.col("trashtime"))).select(*df.columns)
    return result.replace(**woken)
