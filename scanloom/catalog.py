"""The archive catalog: entity schemas, loading, and the hierarchy chain.

research group -> experiment -> subject -> session -> epoch -> dataset is a chain of n:1 keys. Frames are
kept narrow and are only joined when a query asks for the levels; Catalyst then prunes columns, pushes
filters into each scan and picks the join strategy from sizes.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "group": "id long, gid string, name string, created timestamp_ntz",
    "user": "id long, uid string, uid_number int, firstname string, lastname string, email string, "
            "created timestamp_ntz, admin_mode boolean",
    "permission": "id long, pid string, name string",
    "user_group": "user_id long, group_id long",
    "group_permission": "group_id long, permission_id long",
    "research_group": "id long, gid string, name string",
    "group_role": "research_group_id long, user_id long, role string",
    "access": "id long, user_id long, experiment_id long, privilege int",
    "person": "id long",
    "data_container": "id long, timestamp timestamp_ntz, duration interval day to second, "
                      "trashtime timestamp_ntz, dirty boolean, scheduling boolean",
    "experiment": "id long, name string, irb string, owner_id long",
    "subject": "id long, code string, firstname string, lastname string, dob date, experiment_id long, "
               "person_id long",
    "session": "id long, uid binary, exam int, notes string, subject_id long, operator_id long",
    "epoch": "id long, uid binary, series int, acq int, description string, notes string, psd string, "
             "physio_recorded boolean, physio_valid boolean, qa_status string, tr double, te double, "
             "ti double, flip_angle double, pixel_bandwidth double, num_slices int, num_timepoints int, "
             "num_averages double, num_echos int, receive_coil_name string, num_receivers int, "
             "protocol_name string, scanner_name string, size_x int, size_y int, fov string, "
             "scan_type string, num_bands int, prescribed_duration interval day to second, "
             "mm_per_vox string, effective_echo_spacing double, phase_encode_undersample double, "
             "slice_encode_undersample double, acquisition_matrix string, num_mux_cal_cycle int, "
             "session_id long",
    "dataset": "id long, label string, offset interval day to second, trashtime timestamp_ntz, "
               "priority int, kind string, qa_status string, filetype string, datatype string, "
               "updatetime timestamp_ntz, digest binary, compressed boolean, archived boolean, "
               "filenames string, container_id long",
    "dataset_parent": "child_id long, parent_id long",
    "job": "id long, timestamp timestamp_ntz, status string, task string, needs_rerun boolean, "
           "progress int, activity string, data_container_id long",
}

# Closed vocabularies of the data model.
JOB_STATUS = ("pending", "running", "done", "failed", "abandoned", "rerun")
JOB_TASK = ("find", "proc", "find&proc")
DATASET_KIND = ("primary", "secondary", "peripheral", "derived", "web", "qa")
DATASET_FILETYPE = ("pfile", "dicom", "nifti", "bitmap", "img_pyr", "physio", "json")
DATASET_DATATYPE = ("unknown", "mr_fmri", "mr_dwi", "mr_structural", "mr_fieldmap", "mr_spectro")
VOCABULARIES = {
    ("job", "status"): JOB_STATUS,
    ("job", "task"): JOB_TASK,
    ("epoch", "qa_status"): JOB_STATUS,
    ("dataset", "kind"): DATASET_KIND,
    ("dataset", "filetype"): DATASET_FILETYPE,
    ("dataset", "datatype"): DATASET_DATATYPE,
}

#: Hierarchy from the bottom up: level -> (foreign key column, parent level).
PARENT = {
    "dataset": ("container_id", "epoch"),
    "epoch": ("session_id", "session"),
    "session": ("subject_id", "subject"),
    "subject": ("experiment_id", "experiment"),
    "experiment": ("owner_id", "research_group"),
}
LEVELS = ("dataset", "epoch", "session", "subject", "experiment", "research_group")
#: Levels that inherit time, trash and work flags from the container table.
CONTAINERS = ("experiment", "subject", "session", "epoch")


def schema_of(entity: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[entity])


class LazyFrames(Mapping):
    """Frames that are built when first asked for, so a query opens only the tables it reads."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


@dataclass
class Catalog:
    """Named frames of one archive, reachable as attributes."""

    frames: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def replace(self, **frames: DataFrame) -> "Catalog":
        return Catalog(ChainMap(frames, self.frames))

    def prefixed(self, level: str) -> DataFrame:
        """Columns named ``<level>_<column>``; keys named after the level they identify."""
        df = self.frames[level]
        parent_key, parent = PARENT.get(level, (None, None))
        names = []
        for column in df.columns:
            if column == "id":
                names.append(F.col("id").alias(f"{level}_id"))
            elif column == parent_key:
                names.append(F.col(column).alias(f"{parent}_id"))
            else:
                names.append(F.col(column).alias(f"{level}_{column}"))
        return df.select(*names)

    def chain(self, bottom: str, top: str, where: dict[str, Column] | None = None,
              only: DataFrame | None = None) -> DataFrame:
        """Inner-join the levels ``bottom`` .. ``top``; ``where`` holds one predicate per level.

        The join is built from the top down, so that the small, already filtered levels reach the large
        ones as join filters. ``only`` is a frame of allowed ``experiment_id`` values (semi join).
        """
        where = where or {}
        low, high = LEVELS.index(bottom), LEVELS.index(top)
        joined = None
        for level in reversed(LEVELS[low:high + 1]):
            df = self.prefixed(level)
            if level in where:
                df = df.where(where[level])
            if level == "experiment" and only is not None:
                df = df.join(only, "experiment_id", "left_semi")
            joined = df if joined is None else joined.join(df, f"{_above(level)}_id")
        return joined


def _above(level: str) -> str:
    return PARENT[level][1]


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Read entity tables with their declared schemas and flatten the container inheritance."""
    read = lambda name: spark.read.schema(schema_of(name)).parquet(f"{path}/{name}")
    builders = {name: (lambda name=name: read(name)) for name in _DDL}
    for name in CONTAINERS:
        builders[name] = lambda name=name: flatten_container(read("data_container"), read(name))
    builders["dataset"] = lambda: read("dataset").withColumn("filenames", split_filenames("filenames"))
    return Catalog(LazyFrames(builders))


def flatten_container(container: DataFrame, child: DataFrame) -> DataFrame:
    """Joined-table inheritance: child rows extended by the container row that shares their id."""
    return child.join(container, "id")


def split_filenames(column: str) -> Column:
    """``', '``-joined names to an array; an empty or missing string is an empty array."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ", "))


def join_filenames(column: str) -> Column:
    return F.array_join(F.col(column), ", ")


def out_of_vocabulary(df: DataFrame, entity: str) -> DataFrame:
    """Rows holding a value outside the closed vocabulary of any enumerated column."""
    bad = F.lit(False)
    for (owner, column), allowed in VOCABULARIES.items():
        if owner == entity and column in df.columns:
            bad = bad | ~F.coalesce(F.col(column).isin(*allowed), F.lit(True))
    return df.where(bad)
