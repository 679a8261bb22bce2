"""Download manifests and the virtual path tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.functions import names
from scanloom.operators.access import granted
from scanloom.operators.filters import by_kind, hide_raw
from scanloom.operators.listing import readable_datasets
from scanloom.operators.ordering import row_numbers
from scanloom.session import cut_lineage


def unique_targets(files: DataFrame, folder: str, name: str, order: list[str]) -> DataFrame:
    """Give colliding names in one folder plus signs before the first dot, in the given order.

    Each file takes the first free number of plus signs not below its own, earlier files first, so a
    suffixed name can meet a real one (``a+.x`` beside two ``a.x``). Names equal up to those signs form a
    family. Level by level, all files asking for level p or more get consecutive slots from p by arrival;
    what does not fit below the next level present asks again there. Numbering is range-partitioned, so a huge
    family stays distributed. There are few levels: names have at most 255 characters.
    """
    stem, separator, extension = names.split_extension(name)
    bare = F.regexp_replace(stem, r"\++$", "")
    family = [folder, "_base"]
    asks = cut_lineage(files.withColumn("_plus", (F.length(stem) - F.length(bare)).cast("long"))
                       .withColumn("_base", F.concat(bare, separator, extension)))
    levels = [r[0] for r in asks.select("_plus").distinct().orderBy("_plus").collect()]
    settled, overflow = None, None
    for place, plus in enumerate(levels):
        pool = asks.where(F.col("_plus") == plus)
        pool = pool if overflow is None else pool.unionByName(overflow)
        ranked = row_numbers(pool, family, order, "_n").withColumn("_slot", F.col("_n") + (plus - 1)).drop("_n")
        last = place == len(levels) - 1
        fits = ranked if last else ranked.where(F.col("_slot") < levels[place + 1])
        overflow = None if last else ranked.where(F.col("_slot") >= levels[place + 1]).drop("_slot")
        settled = fits if settled is None else settled.unionByName(fits)
    if settled is None:
        settled = asks.withColumn("_slot", F.col("_plus"))
    return settled.withColumn("target", F.concat_ws(
        "/", F.col(folder), names.with_suffix("_base", F.col("_slot").cast("int")))).drop("_plus", "_base", "_slot")


def manifest_files(catalog: Catalog, user_id: int, where: dict[str, Column] | None = None, raw: bool | None = False,
                   legacy: bool = False, root: str = "archive", superuser: bool = False,
                   selected: tuple[str, DataFrame] | None = None) -> DataFrame:
    """One row per downloadable file: source path, target folder, target name (before collisions).

    ``selected``: a level of the hierarchy and the ids (column ``id``) wanted there; repeated, unknown and NULL ids
    change nothing. The ids stay a table and reach their level as a semi-join.
    """
    rows = readable_datasets(catalog, user_id, 1, where, superuser)
    if selected is not None:
        level, ids = selected
        rows = rows.join(ids.select(F.col("id").cast("long").alias(f"{level}_id")), f"{level}_id", "left_semi")
    if raw is not None:
        rows = by_kind(rows, raw, "dataset_kind")
    if legacy:
        session = names.session_legacy_dirname("session_timestamp", "session_exam")
        folder = names.download_dir(root, "research_group_gid", "experiment_name", session)
    else:
        folder = names.download_dir(root, "research_group_gid", "experiment_name",
                                    names.session_dirname("session_timestamp"),
                                    names.epoch_dirname("epoch_series", "epoch_acq", "epoch_description"))
    files = rows.select("dataset_id", folder.alias("folder"), "epoch_series", "epoch_acq", "epoch_description",
                        names.dataset_relpath("dataset_id", "dataset_archived").alias("relpath"),
                        F.posexplode("dataset_filenames").alias("position", "filename"))
    target = names.legacy_filename("filename", "epoch_series", "epoch_acq", "epoch_description") if legacy else F.col("filename")
    return files.select("dataset_id", "position", "folder", F.concat_ws("/", "relpath", "filename").alias("source"),
                        target.alias("name"))


def download_manifest(catalog: Catalog, user_id: int, where: dict[str, Column] | None = None, raw: bool | None = False,
                      legacy: bool = False, root: str = "archive", superuser: bool = False) -> DataFrame:
    """(source, target) for every file of a download, with unique targets."""
    files = manifest_files(catalog, user_id, where, raw, legacy, root, superuser)
    return unique_targets(files, "folder", "name", ["dataset_id", "position"]).select("source", "target")


def download_selected(catalog: Catalog, user_id: int, level: str, ids: DataFrame, raw: bool = False, legacy: bool = False,
                      root: str = "archive", superuser: bool = False) -> DataFrame:
    """(source, target) for the files below the sessions, epochs or datasets of an id list.

    Sessions and epochs give peripheral and derived data, with ``raw`` everything but viewer files; datasets picked
    one by one are given whatever their kind. Trashed rows are included, and each dataset is held against the
    privilege its kind needs.
    """
    if level not in ("session", "epoch", "dataset"):
        raise ValueError(f"no download by ids of a {level}")
    files = manifest_files(catalog, user_id, None, None if level == "dataset" else raw, legacy, root, superuser, (level, ids))
    return unique_targets(files, "folder", "name", ["dataset_id", "position"]).select("source", "target")


# virtual path tree --------------------------------------------------------------------------------


def tree_groups(catalog: Catalog, user_id: int | None, raw_dir: bool = False) -> DataFrame:
    """Group names at the root (trash is ignored here), then the fixed extra entries."""
    experiments = catalog.prefixed("experiment")
    if user_id is not None:
        experiments = experiments.join(granted(catalog, user_id), "experiment_id", "left_semi")
    names_ = experiments.join(catalog.prefixed("research_group"), "research_group_id").select(
        F.col("research_group_gid").alias("name")).distinct().withColumn("place", F.lit(0))
    extra = ["README.txt"] + (["raw"] if raw_dir else [])
    literal = catalog.experiment.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(extra)], "name string, place int")
    return names_.unionAll(literal).orderBy("place", "name")


def _tree(catalog: Catalog, bottom: str, user_id: int | None, group: str, experiment: str | None, trash: bool,
          where: dict[str, Column]) -> DataFrame:
    only = None if user_id is None else granted(catalog, user_id)
    where = dict(where)
    where["research_group"] = F.col("research_group_gid").ilike(group)
    if experiment is not None:
        where["experiment"] = F.col("experiment_name").ilike(experiment)
    if not trash:
        live = F.col(f"{bottom}_trashtime").isNull()
        where[bottom] = where[bottom] & live if bottom in where else live
    return catalog.chain(bottom, "research_group", where, only)


def tree_experiments(catalog, user_id, group: str, trash: bool = False) -> DataFrame:
    return _tree(catalog, "experiment", user_id, group, None, trash, {}).select(
        F.col("experiment_name").alias("name")).orderBy("name")


def tree_sessions(catalog, user_id, group: str, experiment: str, trash: bool = False) -> DataFrame:
    return _tree(catalog, "session", user_id, group, experiment, trash, {}).select(
        names.session_name("session_timestamp", "session_exam").alias("name")).orderBy("name")


def path_filters(session: str = "%", epoch: str = "%") -> dict[str, Column]:
    """Exam, series and acquisition conditions held in path parts; ``%`` leaves a part open."""
    where: dict[str, Column] = {}
    parts = session.split("_")
    exam = parts[2] if len(parts) > 2 else parts[0]
    if "%" not in exam:
        where["session"] = F.col("session_exam") == int(exam)
    pieces = epoch.split("_")
    conditions = []
    if len(pieces) > 1 and "%" not in pieces[1]:
        conditions.append(F.col("epoch_series") == int(pieces[1]))
    if len(pieces) > 2 and "%" not in pieces[2]:
        conditions.append(F.col("epoch_acq") == int(pieces[2]))
    for condition in conditions:
        where["epoch"] = where["epoch"] & condition if "epoch" in where else condition
    return where


def tree_epochs(catalog, user_id, group: str, experiment: str, session: str, trash: bool = False) -> DataFrame:
    parts = session.split("_")
    where = {} if "%" in parts[0] else {"session": F.col("session_exam") == int(parts[2])}
    if len(parts) <= 2 and "%" not in parts[0]:
        where = {"session": F.lit(False)}
    name = names.epoch_name("session_exam", "epoch_series", "epoch_acq")
    return _tree(catalog, "epoch", user_id, group, experiment, trash, where).select(
        F.concat(name, F.lit("_"), "epoch_description").alias("name")).orderBy("name")


def tree_files(catalog, user_id, group: str, experiment: str, session: str = "%", epoch: str = "%",
               hide_raw_data: bool = False, trash: bool = False) -> DataFrame:
    """Files below a path: (name, path). ``%`` for the epoch gives the flat view, ``%t`` the typed one."""
    rows = _tree(catalog, "dataset", user_id, group, experiment, trash, path_filters(session, epoch))
    if hide_raw_data:
        rows = hide_raw(rows, "dataset_kind")
    if "%" not in epoch and len(epoch.split("_")) <= 2:
        rows = rows.where(F.lit(False))
    typed = len(epoch) > 1 and "%" in epoch and epoch[1] == "t"
    if typed:
        rows = rows.where("dataset_filetype = 'nifti'")
    relpath = names.dataset_relpath("dataset_id", "dataset_archived")
    files = rows.withColumn("filename", F.explode("dataset_filenames"))
    if "%" in epoch:
        text = F.col("epoch_scan_type" if typed else "epoch_description")
        shown = names.flat_display_name("filename", "dataset_filenames", "epoch_series", "epoch_acq", text)
    else:
        shown = F.col("filename")
    return files.select(shown.alias("name"), F.concat_ws("/", relpath, F.col("filename")).alias("path"))
