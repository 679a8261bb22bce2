"""Browse listings: what each level shows, in which order, with row ids and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.functions.names import level
from scanloom.functions.sortkey import natural_order
from scanloom.operators.access import children, dataset_threshold, experiments_with_privilege


def _trash_class(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), "trash").otherwise("")


def _row_id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}="), F.col(column).cast("string"))


def list_experiments(catalog: Catalog, user_id: int, mode: int = 0, superuser: bool = False) -> DataFrame:
    owners = catalog.research_group.select(F.col("id").alias("research_group_id"), F.col("gid").alias("owner"))
    rows = experiments_with_privilege(catalog, user_id, mode=mode, superuser=superuser)
    return rows.join(owners, "research_group_id").select(
        "owner", F.col("experiment_name").alias("name"), _row_id("exp", "experiment_id").alias("row_id"),
        F.concat(F.lit("access_"), F.lower("privilege"), F.lit(" "), _trash_class("experiment_trashtime")).alias("row_class"))


def list_sessions(catalog: Catalog, experiment_id: int, user_id: int, mode: int = 0, superuser: bool = False) -> DataFrame:
    return children(catalog, "session", "experiment", experiment_id, user_id, mode=mode, superuser=superuser).select(
        F.date_format("session_timestamp", "yyyy-MM-dd HH:mm").alias("time"), F.col("session_exam").alias("exam"),
        F.col("subject_code").alias("code"), _row_id("sess", "session_id").alias("row_id"),
        _trash_class("session_trashtime").alias("row_class"))


def list_epochs(catalog: Catalog, session_id: int, user_id: int, mode: int = 0, superuser: bool = False) -> DataFrame:
    return children(catalog, "epoch", "session", session_id, user_id, mode=mode, superuser=superuser).select(
        F.date_format("epoch_timestamp", "HH:mm:ss").alias("time"), F.col("epoch_description").alias("description"),
        _row_id("epoch", "epoch_id").alias("row_id"), _trash_class("epoch_trashtime").alias("row_class"))


def dataset_rows(datasets: DataFrame) -> DataFrame:
    """Listing rows of datasets joined to their epoch: the label, and a volume viewer for single volumes."""
    row = lambda label, row_id: F.struct(label.alias("label"), row_id.alias("row_id"))
    plain = row(F.concat("dataset_label", F.when(F.col("dataset_kind") == "primary", "*").otherwise("")),
                _row_id("dataset", "dataset_id"))
    viewer = row(F.lit("Volume viewer"), F.concat(F.lit("dataset=v"), F.col("dataset_id").cast("string")))
    single = (F.col("dataset_filetype") == "nifti") & (F.col("epoch_num_slices") > 1) & (F.col("epoch_num_timepoints") == 1)
    rows = F.when(single, F.array(plain, viewer)).otherwise(F.array(plain))
    return datasets.withColumn("_row", F.explode(rows)).select(
        F.col("_row.label").alias("label"), F.col("_row.row_id").alias("row_id"),
        _trash_class("dataset_trashtime").alias("row_class"))


def readable_datasets(catalog: Catalog, user_id: int, mode: int = 0, where: dict[str, Column] | None = None,
                      superuser: bool = False) -> DataFrame:
    """Datasets with their chain, each held against the privilege its kind needs."""
    where = dict(where or {})
    if mode != 1:
        trash = F.col("dataset_trashtime")
        shown = trash.isNull() if mode == 0 else trash.isNotNull()
        where["dataset"] = where["dataset"] & shown if "dataset" in where else shown
    grants = catalog.access.where(F.col("user_id") == user_id).groupBy("experiment_id").agg(
        F.max("privilege").alias("_has"))
    rows = catalog.chain("dataset", "research_group", where)
    if superuser:
        return rows
    return rows.join(grants, "experiment_id").where(F.col("_has") >= dataset_threshold("dataset_kind")).drop("_has")


def list_datasets(catalog: Catalog, user_id: int, epoch_id: int | None = None, mode: int = 0) -> DataFrame:
    """Dataset listing of one epoch, or of everything the user may see."""
    where = {} if epoch_id is None else {"epoch": F.col("epoch_id") == epoch_id}
    return dataset_rows(readable_datasets(catalog, user_id, mode, where))


def order_listing(df: DataFrame, column: str, descending: bool, tie: str = "row_id") -> DataFrame:
    """Natural order on one cell, ties by row id. Global sorts stay range-partitioned."""
    return df.orderBy(*natural_order(column, descending), tie)


# Column and direction each listing opens with.
DEFAULT_ORDER = {"experiments": ("name", False), "sessions": ("time", True), "search": ("time", True)}


def default_order(df: DataFrame, listing: str) -> DataFrame:
    column, descending = DEFAULT_ORDER[listing]
    return order_listing(df, column, descending)


def status_lists(jobs: DataFrame, pending_limit: int = 200) -> DataFrame:
    """Status board: failed and running jobs, and the first ``pending_limit`` pending ones by id."""
    pick = lambda status: jobs.where(F.col("status") == status).select("id", "status", "task", "activity")
    return pick("failed").unionAll(pick("running")).unionAll(pick("pending").orderBy("id").limit(pending_limit))


def next_jobs(jobs: DataFrame, count: int, task: str | None = None, newest: bool = False, *filters: str) -> DataFrame:
    """Pending jobs to start, oldest or newest id first, within a task and caller filters."""
    waiting = jobs.where("status = 'pending'")
    if task:
        waiting = waiting.where(F.col("task") == task)
    for text in filters:
        waiting = waiting.where(F.expr(text))
    return waiting.orderBy(F.col("id").desc() if newest else F.col("id")).limit(count)


def next_dirty(containers: DataFrame, count: int) -> DataFrame:
    """Dirty containers in time order."""
    return containers.where("dirty").orderBy(F.col("timestamp").asc_nulls_last(), "id").limit(count)


def page_after(df: DataFrame, after_id: int, size: int, key: str = "id") -> DataFrame:
    """Keyset pagination."""
    return df.where(F.col(key) > after_id).orderBy(key).limit(size)


def selected_ids(rows: DataFrame, column: str = "row_id") -> DataFrame:
    """Row ids such as ``sess=44`` as (type, id) — one row per selected id, grouped by ``type``."""
    parts = F.split(F.col(column), "=")
    return rows.select(F.element_at(parts, 1).alias("type"), F.element_at(parts, 2).alias("id"))


def id_lists(rows: DataFrame, column: str = "row_id", chunk: int = 10_000) -> DataFrame:
    """Selected ids as lists per type, in chunks of bounded size (``part`` numbers them).

    Numeric ids of one chunk lie in the same ``chunk``-wide id range, so no list can outgrow it.
    """
    ids = selected_ids(rows, column)
    part = F.floor(F.regexp_extract("id", r"(\d+)", 1).cast("long") / chunk)
    return ids.withColumn("part", part).distinct().groupBy("type", "part").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))


def listing_contract(df: DataFrame, cells: list[str]) -> DataFrame:
    """Listing result in its exchange form: an array of cells and the row attributes."""
    return df.select(F.array(*[F.col(c).cast("string") for c in cells]).alias("data"),
                     F.struct("row_id", "row_class").alias("attrs"))

