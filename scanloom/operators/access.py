"""Row-level security and the people around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.catalog import LEVELS, Catalog
from scanloom.functions.names import level, list_name, privilege_name
from scanloom.operators.filters import LIVE, visible

ANON, READ, WRITE, MANAGE = (level(n) for n in ("Anon-Read", "Read-Only", "Read-Write", "Manage"))


def superusers(catalog: Catalog, group_id: int = 1) -> DataFrame:
    """Users in the superuser group with admin mode on."""
    members = catalog.user_group.where(F.col("group_id") == group_id).select(F.col("user_id").alias("id"))
    return catalog.user.where("admin_mode").join(members, "id", "left_semi")


def granted(catalog: Catalog, user_id: int, min_level: int = ANON) -> DataFrame:
    """Experiment ids one user may see at a level."""
    return catalog.access.where((F.col("user_id") == user_id) & (F.col("privilege") >= min_level)).select("experiment_id")


def secure(df: DataFrame, catalog: Catalog, user_id: int, min_level: int = ANON) -> DataFrame:
    """Rows of experiments the user may see; duplicate grants never duplicate rows."""
    return df.join(granted(catalog, user_id, min_level), "experiment_id", "left_semi")


def experiments_with_privilege(catalog: Catalog, user_id: int, min_level: int = ANON, mode: int = LIVE,
                               superuser: bool = False) -> DataFrame:
    """Visible experiments and the user's privilege; a superuser manages all of them."""
    experiments = visible(catalog.prefixed("experiment"), mode, "experiment_trashtime")
    if superuser:
        return experiments.withColumn("privilege", F.lit("Manage"))
    grants = catalog.access.where((F.col("user_id") == user_id) & (F.col("privilege") >= min_level)).groupBy(
        "experiment_id").agg(F.max("privilege").alias("level"))
    return experiments.join(grants, "experiment_id").withColumn("privilege", privilege_name("level")).drop("level")


def children(catalog: Catalog, child: str, parent: str, parent_id: int, user_id: int, min_level: int = ANON,
             mode: int = LIVE, superuser: bool = False) -> DataFrame:
    """Visible sessions, epochs or datasets below one parent."""
    only = None if superuser else granted(catalog, user_id, min_level)
    where = {parent: F.col(f"{parent}_id") == parent_id}
    if mode != 1:
        trash = F.col(f"{child}_trashtime")
        where[child] = trash.isNull() if mode == LIVE else trash.isNotNull()
    return catalog.chain(child, "experiment", where, only)


def experiment_of(catalog: Catalog, level_name: str) -> DataFrame:
    """``<level>_id`` with the experiment it belongs to."""
    if level_name == "experiment":
        return catalog.prefixed("experiment").select("experiment_id")
    top = LEVELS[LEVELS.index("experiment") - 1]
    return catalog.chain(level_name, top).select(f"{level_name}_id", "experiment_id")


def has_access(catalog: Catalog, requests: DataFrame, level_name: str, needed: Column) -> DataFrame:
    """Batch check: requests (user_id, ``<level>_id``, …) get ``allowed`` against the privilege ``needed``."""
    placed = requests.join(experiment_of(catalog, level_name), f"{level_name}_id", "left")
    best = catalog.access.groupBy("user_id", "experiment_id").agg(F.max("privilege").alias("_has"))
    supers = superusers(catalog).select(F.col("id").alias("user_id"), F.lit(True).alias("_super")).distinct()
    return (placed.join(best, ["user_id", "experiment_id"], "left").join(supers, "user_id", "left")
            .withColumn("allowed", F.coalesce(F.col("_super"), F.lit(False)) | F.coalesce(F.col("_has") >= needed, F.lit(False)))
            .drop("_has", "_super", *([] if level_name == "experiment" else ["experiment_id"])))


def dataset_threshold(kind: str | Column = "kind") -> Column:
    """Original data need Read-Only, everything else Anon-Read."""
    column = F.col(kind) if isinstance(kind, str) else kind
    return F.when(column.isin("primary", "secondary"), READ).otherwise(ANON)


def latest_session(catalog: Catalog, user_id: int, min_level: int = ANON, mode: int = LIVE) -> DataFrame:
    """The most recent accessible session with its experiment (sessions without a time come last)."""
    trash = F.col("session_trashtime")
    where = {} if mode == 1 else {"session": trash.isNull() if mode == LIVE else trash.isNotNull()}
    return (catalog.chain("session", "experiment", where, granted(catalog, user_id, min_level))
            .orderBy(F.col("session_timestamp").desc_nulls_last(), "session_id").limit(1))


def permissions(catalog: Catalog) -> DataFrame:
    """Distinct permissions of every user through group membership."""
    return catalog.user_group.join(catalog.group_permission, "group_id").select("user_id", "permission_id").distinct()


def role_groups(catalog: Catalog) -> DataFrame:
    """Groups every user heads or manages; holding both roles gives two rows."""
    roles = catalog.group_role
    groups = catalog.research_group.select(F.col("id").alias("research_group_id"), "gid")
    heads = roles.where("role = 'pi'").unionAll(roles.where("role = 'manager'"))
    return heads.join(groups, "research_group_id").select("user_id", "gid")


def admin_groups(catalog: Catalog, user_id: int, superuser: bool = False) -> DataFrame:
    """Groups one user administers: all of them for a superuser."""
    if superuser:
        return catalog.research_group.select("gid")
    return role_groups(catalog).where(F.col("user_id") == user_id).select("gid")


def outsiders(catalog: Catalog, group_id: int) -> DataFrame:
    """Users holding no role in the group."""
    inside = catalog.group_role.where(F.col("research_group_id") == group_id).select(F.col("user_id").alias("id"))
    return catalog.user.join(inside, "id", "left_anti")


def member_lists(catalog: Catalog, group_id: int) -> DataFrame:
    """Lists of one group: pis, admins, members, and the others, with uid and name."""
    key = F.when(F.col("role") == "pi", "pis").when(F.col("role") == "manager", "admins").otherwise("members")
    inside = (catalog.group_role.where(F.col("research_group_id") == group_id)
              .select(F.col("user_id").alias("id"), key.alias("list")).join(catalog.user, "id"))
    show = lambda df: df.select("list", "uid", list_name("firstname", "lastname").alias("name"))
    return show(inside).unionAll(show(outsiders(catalog, group_id).withColumn("list", F.lit("others"))))


def user_listing(users: DataFrame) -> DataFrame:
    return users.select("uid", list_name("firstname", "lastname").alias("name"),
                        F.concat(F.lit("uid="), "uid").alias("row_id"))


def users_with_access(catalog: Catalog, experiment_id: int, user_id: int) -> DataFrame:
    """Grants on one experiment: all for its managers and superusers, the own row for everyone else."""
    grants = catalog.access.where(F.col("experiment_id") == experiment_id)
    manages = (grants.where((F.col("user_id") == user_id) & (F.col("privilege") == MANAGE)).select("user_id")
               .unionAll(superusers(catalog).where(F.col("id") == user_id).select(F.col("id").alias("user_id"))))
    everyone = manages.agg(F.count(F.lit(1)) > 0).scalar()
    seen = grants.where(everyone | (F.col("user_id") == user_id))
    return seen.join(catalog.user.select(F.col("id").alias("user_id"), "uid"), "user_id").select(
        "uid", privilege_name("privilege").alias("privilege"))


def shared_experiments(catalog: Catalog, manager_id: int, other_id: int) -> DataFrame:
    """Experiments ``other`` can see, limited to those ``manager`` manages, with the other's privilege."""
    theirs = experiments_with_privilege(catalog, other_id)
    if manager_id == other_id:
        return theirs.select("experiment_id", "privilege")
    managed = visible(catalog.experiment).select(F.col("id").alias("experiment_id")).join(
        granted(catalog, manager_id, MANAGE), "experiment_id", "left_semi")
    return theirs.join(managed, "experiment_id", "left_semi").select("experiment_id", "privilege")


def access_overlay(listing: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """Every listed row with its access class; rows without a grant show ``access_none``."""
    return listing.join(levels.select(key, "privilege"), key, "left").withColumn(
        "row_class", F.concat(F.lit("access_"), F.lower(F.coalesce("privilege", F.lit("none"))))).drop("privilege")


def default_grants(groups: DataFrame, experiments: DataFrame) -> DataFrame:
    """Grants of new experiments: managers and PIs manage, the remaining members read.

    ``groups``: research_group_id, user_id, role. ``experiments``: id, owner_id.
    """
    heads = groups.where(F.col("role").isin("pi", "manager")).select("research_group_id", "user_id").distinct()
    members = (groups.where("role = 'member'").select("research_group_id", "user_id").distinct()
               .join(heads, ["research_group_id", "user_id"], "left_anti"))
    people = heads.withColumn("privilege", F.lit(MANAGE)).unionAll(members.withColumn("privilege", F.lit(READ)))
    return (experiments.select(F.col("id").alias("experiment_id"), F.col("owner_id").alias("research_group_id"))
            .join(people, "research_group_id").select("user_id", "experiment_id", "privilege"))
