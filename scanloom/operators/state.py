"""Catalog maintenance: pure functions from a state and a table of commands to the new state.

Each is a set of joins keyed on ids, so the same SQL can be issued as MERGE where the table format has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import PARENT, Catalog
from scanloom.operators.access import MANAGE, READ, WRITE, has_access, superusers
from scanloom.operators.ordering import row_numbers
from scanloom.operators.rollup import code_number

_ORDER = ("experiment", "subject", "session", "epoch", "dataset")

#: Fixed value: what a job says after it was set back.
RESET = "reset to pending"


def merge_state(state: DataFrame, changes: DataFrame, keys: Sequence[str], delete: str | None = None) -> DataFrame:
    """Full-outer merge: changed columns win where the change row exists, ``delete`` drops rows.

    ``changes`` holds the keys, the columns to set, and optionally a boolean ``delete`` column.
    """
    keys = list(keys)
    marked = changes.withColumn("_change", F.lit(True))
    renamed = marked.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in marked.columns if c not in keys])
    joined = state.join(renamed, keys, "full_outer")
    out = [F.col(k) for k in keys]
    for column in state.columns:
        if column in keys:
            continue
        if column in changes.columns:
            out.append(F.when(F.col("_new__change"), F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column))
        else:
            out.append(F.col(column))
    if delete is not None:
        joined = joined.where(~F.coalesce(F.col(f"_new_{delete}"), F.lit(False)))
    return joined.select(*out).select(*state.columns)


def apply_edits(state: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """Coalescing update: non-NULL values of the edit table replace the stored ones."""
    fields = [c for c in edits.columns if c != key]
    renamed = edits.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = state.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in state.columns])


def edit_experiments(experiments: DataFrame, edits: DataFrame, groups: DataFrame) -> DataFrame:
    """Rename (lower case) and re-own experiments; ``edits``: id, name, owner_gid."""
    owners = groups.select(F.col("gid").alias("owner_gid"), F.col("id").alias("owner_id"))
    ready = edits.join(owners, "owner_gid", "left").select("id", F.lower("name").alias("name"), "owner_id")
    return apply_edits(experiments, ready)


# trash -------------------------------------------------------------------------------------------

def trash_decisions(catalog: Catalog, commands: DataFrame, level: str) -> DataFrame:
    """Per request: trash when any selected row is live, else untrash; refused without Read-Write on all.

    ``commands``: request_id, user_id, id, now. Adds ``action`` (trash, untrash, refused) to every command.
    """
    asks = commands.withColumnRenamed("id", f"{level}_id")
    checked = has_access(catalog, asks, level, F.lit(WRITE))
    state = catalog.frames[level].select(F.col("id").alias(f"{level}_id"), F.col("trashtime").isNull().alias("_live"))
    seen = checked.join(state, f"{level}_id")
    verdict = seen.groupBy("request_id").agg(F.bool_and("allowed").alias("_ok"), F.bool_or("_live").alias("_any"))
    action = F.when(~F.col("_ok"), "refused").when(F.col("_any"), "trash").otherwise("untrash")
    return (seen.join(verdict.select("request_id", action.alias("action")), "request_id")
            .select("request_id", F.col(f"{level}_id").alias("id"), "now", "action"))


def _descend(catalog: Catalog, level: str, marks: DataFrame) -> dict[str, DataFrame]:
    """Marked ids at ``level`` and at every level below; ``marks`` is (id, …payload)."""
    out = {level: marks}
    for child in _ORDER[_ORDER.index(level) + 1:]:
        key = PARENT[child][0]
        below = catalog.frames[child].select("id", F.col(key).alias("_up"))
        marks = below.join(marks.withColumnRenamed("id", "_up"), "_up").drop("_up")
        out[child] = marks
    return out


def _ascend(catalog: Catalog, level: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Ids of every ancestor of the given ids."""
    out = {}
    while level != "experiment":
        key, parent = PARENT[level]
        ids = catalog.frames[level].join(ids, "id", "left_semi").select(F.col(key).alias("id")).distinct()
        out[parent] = ids
        level = parent
    return out


def trash(catalog: Catalog, level: str, selected: DataFrame) -> Catalog:
    """Trash rows and everything below them at the caller's time; ``selected``: id, now."""
    marks = selected.groupBy("id").agg(F.max("now").alias("_now"))
    changed = {}
    for name, ids in _descend(catalog, level, marks).items():
        df = catalog.frames[name]
        changed[name] = df.join(ids, "id", "left").withColumn(
            "trashtime", F.coalesce("_now", "trashtime")).select(*df.columns)
    return catalog.replace(**changed)


def untrash(catalog: Catalog, level: str, selected: DataFrame) -> Catalog:
    """Restore rows, everything below them, and their ancestors (not the ancestors' other children)."""
    ids = selected.select("id").distinct()
    down = _descend(catalog, level, ids)
    up = _ascend(catalog, level, ids)
    changed = {}
    for name, found in {**up, **down}.items():
        df = catalog.frames[name]
        marked = df.join(found.withColumn("_restore", F.lit(True)), "id", "left")
        changed[name] = marked.withColumn("trashtime", F.when(F.col("_restore").isNull(), F.col("trashtime"))).select(*df.columns)
    return catalog.replace(**changed)


# access ------------------------------------------------------------------------------------------

def access_verdicts(catalog: Catalog, commands: DataFrame) -> DataFrame:
    """All-or-nothing check of access requests: (request_id, success).

    ``commands``: request_id, requester_id, user_id, experiment_id, privilege. Refused when the requester does
    not manage an experiment, or when a target user heads the group that owns it.
    """
    asks = commands.withColumnRenamed("user_id", "target_id").withColumnRenamed("requester_id", "user_id")
    checked = has_access(catalog, asks, "experiment", F.lit(MANAGE))
    owners = catalog.experiment.select(F.col("id").alias("experiment_id"), F.col("owner_id").alias("research_group_id"))
    heads = catalog.group_role.where("role = 'pi'").select(
        "research_group_id", F.col("user_id").alias("target_id")).distinct().withColumn("_head", F.lit(True))
    seen = checked.join(owners, "experiment_id").join(heads, ["research_group_id", "target_id"], "left")
    return seen.groupBy("request_id").agg(
        F.bool_and(F.col("allowed") & F.col("_head").isNull()).alias("success"))


def change_access(catalog: Catalog, commands: DataFrame) -> Catalog:
    """Grant, change or (privilege NULL) revoke access; only requests that pass as a whole take effect.

    For the same user and experiment the highest request id wins.
    """
    passed = access_verdicts(catalog, commands).where("success").select("request_id")
    last = (commands.join(passed, "request_id", "left_semi").groupBy("user_id", "experiment_id")
            .agg(F.max(F.struct("request_id", "privilege")).alias("_last"))
            .select("user_id", "experiment_id", F.col("_last.privilege").alias("privilege"))
            .withColumn("revoke", F.col("privilege").isNull()))
    return catalog.replace(access=merge_state(catalog.access, last, ["user_id", "experiment_id"], "revoke"))


# List names of the membership dialog and the access they carry over.
MEMBERSHIP = {"pis": ("pi", MANAGE), "admins": ("manager", MANAGE), "members": ("member", READ)}


def change_membership(catalog: Catalog, commands: DataFrame) -> tuple[Catalog, DataFrame]:
    """Move users between the lists of a group; returns the new catalog and (request_id, success).

    ``commands``: request_id, requester_id, research_group_id, user_id, src, dst, retroactive. The requester
    must manage the group, and head it when heads are moved. ``retroactive`` also rewrites access to the
    group's experiments, under the rules of ``change_access``: nobody may change a head's access, so a
    retroactive move to the heads fails while the group owns an experiment.
    """
    supers = superusers(catalog).select(F.col("id").alias("requester_id"), F.lit(True).alias("_super")).distinct()
    rank = catalog.group_role.where(F.col("role").isin("pi", "manager")).groupBy(
        "research_group_id", F.col("user_id").alias("requester_id")).agg(F.bool_or(F.col("role") == "pi").alias("_pi"))
    heads = F.col("src").eqNullSafe("pis") | F.col("dst").eqNullSafe("pis")
    seen = (commands.join(supers, "requester_id", "left").join(rank, ["research_group_id", "requester_id"], "left"))
    may = F.col("_super").isNotNull() | (F.col("_pi").isNotNull() & (~heads | F.coalesce("_pi", F.lit(False))))
    owned = catalog.experiment.select(F.col("owner_id").alias("research_group_id"), F.col("id").alias("experiment_id"))
    value = F.lit(None).cast("int")
    for name, (_, privilege) in MEMBERSHIP.items():
        value = F.when(F.col("dst") == name, privilege).otherwise(value)
    involved = F.col("src").isin(*MEMBERSHIP) | F.col("dst").isin(*MEMBERSHIP)
    retro = commands.where(F.col("retroactive") & involved).join(owned, "research_group_id").withColumn("privilege", value)
    moved_from = retro.where("src = 'pis'").select("research_group_id", "user_id").distinct().withColumn("_was", F.lit(True))
    roles_after = (catalog.group_role.join(moved_from, ["research_group_id", "user_id"], "left")
                   .where(~((F.col("role") == "pi") & F.col("_was").isNotNull())).drop("_was"))
    raised = retro.where("dst = 'pis'").select("research_group_id", "user_id", F.lit("pi").alias("role")).distinct()
    checked = access_verdicts(catalog.replace(group_role=roles_after.unionByName(raised)), retro.select(
        "request_id", "requester_id", "user_id", "experiment_id", "privilege")).withColumnRenamed("success", "_retro")
    verdict = seen.groupBy("request_id").agg(F.bool_and(may).alias("_may")).join(checked, "request_id", "left").select(
        "request_id", (F.col("_may") & F.coalesce("_retro", F.lit(True))).alias("success"))
    accepted = commands.join(verdict.where("success"), "request_id", "left_semi")
    role_of = lambda c: F.when(F.col(c) == "pis", "pi").when(F.col(c) == "admins", "manager").when(F.col(c) == "members", "member")
    gone = accepted.select("research_group_id", "user_id", role_of("src").alias("role")).where("role is not null")
    come = accepted.select("research_group_id", "user_id", role_of("dst").alias("role")).where("role is not null").distinct()
    keys = ["research_group_id", "user_id", "role"]
    roles = catalog.group_role.join(gone, keys, "left_anti").join(come, keys, "left_anti").select(*keys).unionByName(come)
    last = (retro.join(accepted.select("request_id"), "request_id", "left_semi").groupBy("user_id", "experiment_id")
            .agg(F.max(F.struct("request_id", "privilege")).alias("_last"))
            .select("user_id", "experiment_id", F.col("_last.privilege").alias("privilege"))
            .withColumn("revoke", F.col("privilege").isNull()))
    grants = merge_state(catalog.access, last, ["user_id", "experiment_id"], "revoke")
    return catalog.replace(group_role=roles, access=grants), verdict


# moving sessions ---------------------------------------------------------------------------------

def move_verdicts(catalog: Catalog, moves: DataFrame) -> DataFrame:
    """(request_id, success): Read-Write on every session and on the target experiment."""
    own = has_access(catalog, moves.select("request_id", "user_id", "session_id"), "session", F.lit(WRITE))
    there = has_access(catalog, moves.select("request_id", "user_id", "experiment_id"), "experiment", F.lit(WRITE))
    return own.select("request_id", "allowed").unionAll(there.select("request_id", "allowed")).groupBy(
        "request_id").agg(F.bool_and("allowed").alias("success"))


def move_sessions(catalog: Catalog, moves: DataFrame) -> Catalog:
    """Move sessions to another experiment; ``moves``: session_id, experiment_id (one row per session).

    The session goes to the same person's subject there; otherwise its subject is cloned with the next code.
    Subjects left empty are dropped, and a trashed target is restored when a live session arrives.
    """
    subjects, sessions = catalog.subject, catalog.session
    person = subjects.select(F.col("id").alias("subject_id"), "person_id")
    placed = (moves.withColumnRenamed("experiment_id", "_to")
              .join(sessions.select(F.col("id").alias("session_id"), "subject_id", "trashtime"), "session_id")
              .join(person, "subject_id"))
    there = subjects.groupBy(F.col("experiment_id").alias("_to"), "person_id").agg(F.min("id").alias("_found"))
    looked = placed.join(there, ["_to", "person_id"], "left")
    first = looked.where("_found is null").groupBy("_to", "person_id").agg(
        F.min(F.struct("session_id", "subject_id")).alias("_first"))
    ordered = row_numbers(first.select("_to", "person_id", F.col("_first.session_id").alias("_s"),
                                       F.col("_first.subject_id").alias("_source")), ["_to"], ["_s"], "_n")
    numbered = row_numbers(ordered, [], ["_to", "_s"], "_k")
    used = subjects.groupBy(F.col("experiment_id").alias("_to")).agg(F.max(code_number()).alias("_used"))
    top = subjects.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = (numbered.join(used, "_to", "left")
             .select((top + F.col("_k")).alias("_new"), "_to", "person_id", "_source",
                     F.format_string("s%03d", F.coalesce("_used", F.lit(0)) + F.col("_n")).alias("_code")))
    source = subjects.join(fresh.drop("person_id").withColumnRenamed("_source", "id"), "id")
    clones = source.select(*[{"id": F.col("_new"), "experiment_id": F.col("_to"), "code": F.col("_code")}
                             .get(c, F.col(c)).alias(c) for c in subjects.columns])
    target = (looked.join(fresh.select("_to", "person_id", "_new"), ["_to", "person_id"], "left")
              .select(F.col("session_id").alias("id"), F.coalesce("_found", "_new").alias("_subject"), "_to",
                      F.col("trashtime").alias("_trash")))
    moved = sessions.join(target.select("id", "_subject"), "id", "left").withColumn(
        "subject_id", F.coalesce("_subject", "subject_id")).select(*sessions.columns)
    touched = placed.select(F.col("subject_id").alias("id")).distinct()
    empty = touched.join(moved.select(F.col("subject_id").alias("id")), "id", "left_anti")
    restored = target.where("_trash is null").select(F.col("_to").alias("id")).distinct().withColumn("_live", F.lit(True))
    experiments = catalog.experiment
    woken = experiments.join(restored, "id", "left").withColumn(
        "trashtime", F.when(F.col("_live").isNull(), F.col("trashtime"))).select(*experiments.columns)
    return catalog.replace(session=moved, experiment=woken,
                           subject=subjects.join(empty, "id", "left_anti").unionByName(clones))


# jobs and work flags -----------------------------------------------------------------------------

def mark_dirty(containers: DataFrame, updated: DataFrame) -> DataFrame:
    """Containers of updated datasets (``updated``: container_id) become dirty."""
    ids = updated.select(F.col("container_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return containers.join(ids, "id", "left").withColumn("dirty", F.col("dirty") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def schedule_jobs(jobs: DataFrame, digests: DataFrame, task: str = "find&proc") -> DataFrame:
    """New job table after a digest check; ``digests``: container_id, old_digest, new_digest, now.

    A changed container gets a pending job, or its job is flagged for a rerun unless already pending or flagged.
    """
    changed = digests.where(~F.col("old_digest").eqNullSafe(F.col("new_digest"))).select(
        F.col("container_id").alias("data_container_id"), "now")
    held = jobs.where(F.col("task") == task)
    first = held.groupBy("data_container_id").agg(F.min("id").alias("id"))
    flagged = first.join(changed, "data_container_id", "left_semi").select("id", F.lit(True).alias("_changed"))
    flag = F.col("_changed").isNotNull() & (F.col("status") != "pending") & ~F.col("needs_rerun")
    kept = jobs.join(flagged, "id", "left").withColumn("needs_rerun", F.col("needs_rerun") | flag).select(*jobs.columns)
    missing = row_numbers(changed.join(first, "data_container_id", "left_anti"), [], ["data_container_id"], "_n")
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    values = {"id": top + F.col("_n"), "timestamp": F.col("now"), "status": F.lit("pending"),
              "task": F.lit(task), "needs_rerun": F.lit(False), "activity": F.lit("pending"),
              "data_container_id": F.col("data_container_id")}
    created = missing.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in jobs.schema.fields])
    return kept.unionByName(created)


def relaunch_jobs(jobs: DataFrame) -> DataFrame:
    """Flagged jobs that are neither running nor abandoned go back to pending."""
    hit = ~F.col("status").isin("running", "abandoned") & F.col("needs_rerun")
    return (jobs.withColumn("_hit", hit).withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status")))
            .withColumn("activity", F.when(F.col("_hit"), RESET).otherwise(F.col("activity")))
            .withColumn("needs_rerun", F.col("needs_rerun") & ~F.col("_hit")).drop("_hit"))


def reset_jobs(jobs: DataFrame, task: str | None = None) -> DataFrame:
    """After a crash: running and failed jobs (of one task) go back to pending."""
    hit = F.col("status").isin("running", "failed") & (F.lit(True) if task is None else F.col("task") == task)
    return (jobs.withColumn("_hit", hit).withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status")))
            .withColumn("activity", F.when(F.col("_hit"), RESET).otherwise(F.col("activity"))).drop("_hit"))


def reset_containers(containers: DataFrame) -> DataFrame:
    """After a crash: containers in scheduling become dirty again."""
    return containers.withColumn("dirty", F.col("dirty") | F.col("scheduling")).withColumn("scheduling", F.lit(False))


def qa_status_after(status, force, has_image, timepoints, nskip, error, status_now, short: str = "abandoned") -> Column:
    """QA status of an epoch after one report attempt.

    Runs only from pending or rerun (or forced); no image stays pending, too few frames gives ``short``, an error
    gives failed, and a rerun asked for meanwhile (``status_now``) survives.
    """
    starts = F.coalesce(force, F.lit(False)) | status.isin("pending", "rerun")
    ended = (F.when(~has_image, "pending").when(error, "failed")
             .when(F.coalesce(timepoints, F.lit(0)) < nskip + 3,
                   F.lit(short))
             .when(status_now == "rerun", "rerun").otherwise("done"))
    return F.when(~F.coalesce(starts, F.lit(False)), status).otherwise(ended)


def qa_sweep(epochs: DataFrame, datasets: DataFrame, files: DataFrame, scan_type: str) -> tuple[DataFrame, DataFrame]:
    """Finished epochs whose report is gone go to rerun; reports without their file are dropped.

    ``files``: dataset_id, filename present in the store. Returns (epochs, datasets).
    """
    reports = datasets.where("filetype = 'json' and label = 'QA'").select(
        F.col("id").alias("dataset_id"), "container_id", F.try_element_at("filenames", F.lit(1)).alias("filename"))
    done = epochs.where((F.col("qa_status") == "done") & (F.col("scan_type") == scan_type)).select(F.col("id").alias("container_id"))
    present = files.select("dataset_id", "filename").distinct()
    mine = reports.join(done, "container_id", "left_semi")
    broken = mine.join(present, ["dataset_id", "filename"], "left_anti").select(F.col("dataset_id").alias("id"))
    sound = mine.join(present, ["dataset_id", "filename"], "left_semi")
    lost = done.join(sound, "container_id", "left_anti").select(F.col("container_id").alias("id")).withColumn("_lost", F.lit(True))
    swept = epochs.join(lost, "id", "left").withColumn(
        "qa_status", F.when(F.col("_lost"), "rerun").otherwise(F.col("qa_status"))).select(*epochs.columns)
    return swept, datasets.join(broken, "id", "left_anti")


def clear_outputs(datasets: DataFrame, containers: DataFrame, kinds: Sequence[str] = ("derived", "web", "qa")) -> DataFrame:
    """Drop earlier outputs of the given kinds from containers about to be processed again."""
    ids = containers.select(F.col("id").alias("container_id")).distinct()
    doomed = datasets.where(F.col("kind").isin(*kinds)).join(ids, "container_id", "left_semi").select("id")
    return datasets.join(doomed, "id", "left_anti")


def merge_archives(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """File set of an archive after a new copy arrives; both: key, digest, files.

    Equal digests replace the stored copy; different or missing ones give the union, new names last.
    """
    new = incoming.select("key", F.col("digest").alias("_digest"), F.col("files").alias("_files"))
    same = F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))
    joined = stored.join(new, "key", "full_outer")
    files = (F.when(F.col("files").isNull(), F.col("_files")).when(F.col("_files").isNull(), F.col("files"))
             .when(same, F.col("_files")).otherwise(F.array_union("files", "_files")))
    action = (F.when(F.col("files").isNull(), "store").when(F.col("_files").isNull(), "keep")
              .when(same, "replace").otherwise("merge"))
    return joined.select("key", files.alias("files"), action.alias("action"))


def register_files(catalog: Catalog, commands: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add files to a dataset, or to a new derived dataset of an (exam, series, acq).

    ``commands``: request_id, dataset_id (or NULL with exam, series, acq), filetype, label, names, force.
    ``listing``: names that exist at the source. Returns the dataset table and (request_id, outcome).
    Existing datasets refuse a request unless some file is new and present, or force is set.
    """
    from scanloom.functions.names import default_label

    there = listing.select("name").distinct()
    named = commands.select("request_id", F.explode("names").alias("name"))
    found = named.join(there, "name", "left_semi").groupBy("request_id").agg(F.array_sort(F.collect_set("name")).alias("_found"))
    asks = commands.join(found, "request_id", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    datasets = catalog.dataset
    old = asks.where("dataset_id is not null").join(
        datasets.select(F.col("id").alias("dataset_id"), "filenames"), "dataset_id", "left")
    fresh = F.array_except("_found", "filenames")
    outcome = (F.when(F.col("filenames").isNull(), "no dataset").when(F.size("_found") == 0, "missing file")
               .when((F.size(fresh) > 0) | F.col("force"), "added").otherwise("name conflict"))
    judged = old.withColumn("outcome", outcome)
    added = judged.where("outcome = 'added'").groupBy(F.col("dataset_id").alias("id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found")))).alias("_new"))
    grown = datasets.join(added, "id", "left").withColumn(
        "filenames", F.when(F.col("_new").isNull(), F.col("filenames")).otherwise(F.array_union("filenames", "_new"))).select(*datasets.columns)
    places = catalog.chain("epoch", "session").groupBy(
        F.col("session_exam").alias("exam"), F.col("epoch_series").alias("series"), F.col("epoch_acq").alias("acq")).agg(
        F.min("epoch_id").alias("container_id"))
    made = asks.where("dataset_id is null").join(places, ["exam", "series", "acq"], "left")
    numbered = row_numbers(made.where("container_id is not null"), [], ["request_id"], "_n")
    top = datasets.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    values = {"id": top + F.col("_n"), "container_id": F.col("container_id"), "kind": F.lit("derived"),
              "filetype": F.col("filetype"), "label": F.coalesce("label", default_label("filetype")),
              "filenames": F.col("_found"), "archived": F.lit(False), "compressed": F.lit(False), "priority": F.lit(0)}
    created = numbered.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in datasets.schema.fields])
    outcomes = judged.select("request_id", "outcome").unionByName(made.select(
        "request_id", F.when(F.col("container_id").isNull(), "no epoch").otherwise("created").alias("outcome")))
    return grown.unionByName(created), outcomes
