"""Display names, directory names and file names of catalog entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.text import _c, clean_string

# Privilege levels, default dataset labels, file rules and listing labels.
PRIVILEGES = {1: "Anon-Read", 2: "Read-Only", 3: "Read-Write", 4: "Manage"}
DEFAULT_LABELS = {
    "pfile": "GE PFile",
    "dicom": "Dicom Data",
    "nifti": "NIfTI",
    "bitmap": "Bitmap",
    "img_pyr": "Image Viewer",
    "physio": "Physio Data",
    "json": "QA",
}
PRIMARY_FILE_RULES = {
    "pfile": r"^P.{5}\.7\.gz$",
    "dicom": r"_dicoms\.tgz$",
    "nifti": r"\.nii\.gz$",
    "bitmap": r"\.png$",
    "img_pyr": r"\.pyrdb$",
    "physio": r"\.physio\.tgz$",
}
LEGACY_SUFFIXES = ("_B0", "_physio", "_dicoms")


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def privilege_name(column: str | Column) -> Column:
    return F.try_element_at(_literal_map(PRIVILEGES), _c(column).cast("int"))


def privilege_value(column: str | Column) -> Column:
    return F.try_element_at(_literal_map({v: k for k, v in PRIVILEGES.items()}), _c(column))


def level(name: str) -> int:
    return {v: k for k, v in PRIVILEGES.items()}[name]


def session_dirname(timestamp: str | Column) -> Column:
    return F.date_format(_c(timestamp), "yyyyMMdd_HHmm")


def session_name(timestamp: str | Column, exam: str | Column) -> Column:
    return F.concat(session_dirname(timestamp), F.lit("_"), _c(exam).cast("string"))


def session_legacy_dirname(timestamp: str | Column, exam: str | Column) -> Column:
    return F.concat(F.date_format(_c(timestamp), "yyyyMMdd"), F.lit("_"), _c(exam).cast("string"))


def _acq_suffix(acq: str | Column) -> Column:
    return F.coalesce(F.concat(F.lit("_"), _c(acq).cast("string")), F.lit(""))


def epoch_name(exam, series, acq) -> Column:
    return F.concat(_c(exam).cast("string"), F.lit("_"), _c(series).cast("string"), _acq_suffix(acq))


def epoch_dirname(series, acq, description) -> Column:
    return F.concat(_c(series).cast("string"), _acq_suffix(acq), F.lit("_"), _c(description))


def dataset_relpath(dataset_id, archived) -> Column:
    return F.concat(F.when(_c(archived), "archive").otherwise("current"),
                    F.format_string("/%03d/%08d", F.pmod(_c(dataset_id), F.lit(1000)), _c(dataset_id)))


def primary_file(filenames, filetype) -> Column:
    """The file of a dataset to open first; NULL when a rule exists and no name satisfies it."""
    names = _c(filenames)
    first = F.try_element_at(names, F.lit(1))
    chosen = first
    matching = lambda rule: F.filter(names, lambda f: f.rlike(rule))
    for kind, rule in PRIMARY_FILE_RULES.items():
        hits = matching(rule)
        chosen = F.when(_c(filetype) == kind, F.try_element_at(hits, F.lit(1))).otherwise(chosen)
    return F.when(F.size(names) <= 1, first).otherwise(chosen)


def split_extension(filename) -> tuple[Column, Column, Column]:
    """(stem, separator, extension) around the first dot."""
    name = _c(filename)
    stem = F.substring_index(name, ".", 1)
    dotted = F.contains(name, F.lit("."))
    separator = F.when(dotted, ".").otherwise("")
    return stem, separator, F.when(dotted, F.substring(name, F.length(stem) + 2, F.lit(1 << 30))).otherwise("")


def legacy_filename(filename, series, acq, description) -> Column:
    """``0003_01_description.ext``, keeping the marker some products carry before the extension."""
    stem, _, extension = split_extension(filename)
    marker = F.lit("")
    for suffix in LEGACY_SUFFIXES:
        marker = F.when(stem.endswith(suffix), suffix).otherwise(marker)
    return F.concat(F.format_string("%04d_%02d_", _c(series), F.coalesce(_c(acq), F.lit(0))),
                    _c(description), marker, F.lit("."), extension)


def with_suffix(filename, count) -> Column:
    """``count`` plus signs inserted before the first dot."""
    stem, separator, extension = split_extension(filename)
    return F.concat(stem, F.repeat(F.lit("+"), _c(count)), separator, extension)


def common_prefix_length(names) -> Column:
    """Length of the common prefix of all strings in an array (first and last in order decide)."""
    ordered = F.array_sort(_c(names))
    first, last = F.element_at(ordered, 1), F.element_at(ordered, -1)
    same = F.filter(F.sequence(F.lit(0), F.length(first)),
                    lambda n: F.substring(first, F.lit(1), n) == F.substring(last, F.lit(1), n))
    return F.array_max(same)


def extension_start(filenames) -> Column:
    names = _c(filenames)
    return F.when(F.size(names) > 1, F.greatest(F.lit(0), common_prefix_length(names) - 1)).otherwise(
        F.length(F.substring_index(F.try_element_at(names, F.lit(1)), ".", 1)))


def flat_display_name(filename, filenames, series, acq, text) -> Column:
    """Flat-view name: series, acquisition, text and whatever follows the shared prefix."""
    tail = F.substring(_c(filename), extension_start(filenames) + 1, F.lit(1 << 30))
    return F.concat(F.format_string("%04d_%02d_", _c(series), F.coalesce(_c(acq), F.lit(0))), _c(text), tail)


def download_dir(root: str, group, experiment, session, epoch=None) -> Column:
    parts = [F.lit(root), _c(group), _c(experiment), _c(session)]
    return F.concat_ws("/", *(parts + ([_c(epoch)] if epoch is not None else [])))


def list_name(first, last) -> Column:
    """``Last, First``; without both, the last name alone."""
    both = (F.coalesce(_c(first), F.lit("")) != "") & (F.coalesce(_c(last), F.lit("")) != "")
    return F.when(both, F.concat(_c(last), F.lit(", "), _c(first))).otherwise(_c(last))


def display_name(first, last, uid) -> Column:
    """``First Last``; without both, the uid."""
    both = (F.coalesce(_c(first), F.lit("")) != "") & (F.coalesce(_c(last), F.lit("")) != "")
    return F.when(both, F.concat(_c(first), F.lit(" "), _c(last))).otherwise(_c(uid))


def default_label(filetype) -> Column:
    return F.try_element_at(_literal_map(DEFAULT_LABELS), _c(filetype))


def dataset_name(label) -> Column:
    return clean_string(label)


def slice_color(index, n_slices) -> Column:
    """Colour of one slice in a red-less ramp over all slices."""
    step = F.floor(F.lit(239) / F.greatest(_c(n_slices) - 1, F.lit(1)))
    return F.concat(F.lit("#10"), F.lower(F.hex(_c(index) * step + 16)), F.lower(F.hex(F.lit(255) - _c(index) * step)))


def recon_type(description) -> Column:
    text = F.lower(_c(description))
    return (F.when(text.endswith("_ssg") | text.endswith("_sbref"), "split-slice-grappa_sense1")
            .when(F.contains(text, F.lit("sense1")), "1Dgrappa_sense1"))


def rename_qa_files(filenames, epoch) -> Column:
    """``qa_report.*`` renamed to ``<epoch>_qa.*``; other names stay."""
    return F.transform(_c(filenames), lambda f: F.when(
        F.regexp_replace(f, r"\.[^.]*$", "") == "qa_report",
        F.concat(_c(epoch), F.lit("_qa"), F.regexp_extract(f, r"(\.[^.]*)$", 1))).otherwise(f))


def infix_rename(filenames, infix: str) -> Column:
    """Insert a marker before the first dot of every name."""
    def one(f: Column) -> Column:
        stem = F.substring_index(f, ".", 1)
        return F.concat(stem, F.lit(infix), F.lit("."), F.substring(f, F.length(stem) + 2, F.lit(1 << 30)))
    return F.transform(_c(filenames), one)


def staged_route(filename) -> Column:
    """How a staged file is handled, by name."""
    name = _c(filename)
    return (F.when(F.contains(name, F.lit("gephysio")), "physio")
            .when(F.contains(name, F.lit("pfile")), "pfile").otherwise("other"))


def pipeline_route(filetype) -> Column:
    return F.when(_c(filetype) == "dicom", "dicom").when(_c(filetype) == "pfile", "pfile")


def end_of_day(timestamp) -> Column:
    return (F.date_trunc("day", _c(timestamp)).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59)))
