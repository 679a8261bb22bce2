"""Text clean-up, header parsing and identifier packing, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def clean_string(column: str | Column) -> Column:
    """Drop unusual characters, join runs of space/dash/underscore by one ``_`` and trim it."""
    kept = F.regexp_replace(F.coalesce(_c(column), F.lit("")), "[^A-Za-z0-9 _-]", "")
    return F.btrim(F.regexp_replace(kept, "[ _-]+", "_"), F.lit("_"))


def patient_id_parts(column: str | Column) -> Column:
    """``code@lab/experiment`` as struct(subj_code, lab_id, exp_id), before the lab is matched."""
    def parts(text: Column) -> Column:
        code = F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, r"(?s)^(.*)@", 1)).otherwise("")
        info = F.substring_index(text, "@", -1)
        rest = F.when(F.contains(info, F.lit("/")), F.regexp_extract(info, r"(?s)^[^/]*/(.*)$", 1)).otherwise("")
        named = lambda value, empty: _once(clean_string(value), lambda v: F.when(v == "", empty).otherwise(v))
        return F.struct(code.alias("subj_code"),
                        named(F.substring_index(info, "/", 1), "unknown").alias("lab_id"),
                        named(rest, "untitled").alias("exp_id"))
    return _once(F.lower(F.regexp_replace(_c(column), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")), parts)


def _capitalize(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 1 << 30)))


def parse_subject(name: str | Column, dob: str | Column) -> Column:
    """``Last^First`` and ``YYYYMMDD`` as struct(firstname, lastname, dob); bad dates become NULL."""
    parts = F.split(_c(name), r"\^")
    named = F.size(parts) == 2
    day = F.when(_c(dob).rlike(r"^\d{8}$"), F.try_to_timestamp(_c(dob), F.lit("yyyyMMdd")).cast("date"))
    return F.struct(
        F.when(named, _capitalize(F.element_at(parts, 2))).otherwise("").alias("firstname"),
        F.when(named, _capitalize(F.element_at(parts, 1))).otherwise("").alias("lastname"),
        F.when(day >= F.lit("1900-01-01").cast("date"), day).alias("dob"))


def pack_uid(column: str | Column) -> Column:
    """Dotted uid to half-byte codes: digit + 1, dot = 11, padded with 0 to whole bytes."""
    codes = F.translate(_c(column), "0123456789.", "123456789ab")
    even = F.when(F.length(codes) % 2 == 1, F.concat(codes, F.lit("0"))).otherwise(codes)
    return F.unhex(even)


def unpack_uid(column: str | Column) -> Column:
    codes = F.regexp_replace(F.lower(F.hex(_c(column))), "0", "")
    return F.translate(codes, "123456789ab", "0123456789.")


# Size suffixes from kilo upwards.
_SIZE_SUFFIXES = "KMGTPEZY"


def human_size(column: str | Column) -> Column:
    """Byte count as three significant characters and a suffix."""
    size = _c(column).cast("double")
    text = F.format_string("%.0fY", size / F.lit(float(1024 ** 8)))
    for power in range(len(_SIZE_SUFFIXES), 0, -1):
        part = size / F.lit(float(1024 ** power))
        suffix = _SIZE_SUFFIXES[power - 1]
        text = (F.when(part < 10.0, F.format_string(f"%3.1f{suffix}", F.bround(part, 1)))
                .when(part < 1000.0, F.format_string(f"%3.0f{suffix}", F.bround(part, 0)))
                .otherwise(text))
    return F.when(size < 1000, F.format_string("%3dB", _c(column).cast("long"))).otherwise(text)


def staged_name(column: str | Column) -> Column:
    """Last four ``_``-separated tokens of a staged file name."""
    tokens = F.split(_c(column), "_")
    start = F.greatest(F.size(tokens) - 3, F.lit(1))
    return F.array_join(F.slice(tokens, start, F.lit(4)), "_")


def bracket_list(column: str | Column) -> Column:
    """``'[1.0, 2.5]'`` or ``'(1, 2)'`` to an array of doubles."""
    inner = F.regexp_replace(_c(column), r"^\s*[\[(]|[\])]\s*$", "")
    values = F.split(inner, r"\s*,\s*|\s+")
    return F.transform(F.filter(values, lambda v: v != ""), lambda v: v.try_cast("double"))


def key_values(column: str | Column) -> Column:
    """``key=value;key=value`` description text to a map."""
    return F.str_to_map(_c(column), F.lit(";"), F.lit("="))


def phase_direction(column: str | Column) -> Column:
    """+1 when the first digit of ``pe`` is 1, else -1."""
    first = F.substring(F.try_element_at(key_values(column), F.lit("pe")), 1, 1)
    return F.when(first == "1", 1).when(first.isNotNull(), -1)


def readout_time(column: str | Column, dim: str | Column) -> Column:
    """Echo spacing (ms) times the phase-encode dimension, in seconds."""
    spacing = F.try_element_at(key_values(column), F.lit("ec")).try_cast("double")
    return spacing * _c(dim) / 1000.0


def physio_file_time(column: str | Column) -> Column:
    """Recording time held in a physio file name (``_MMDDYYYYHH_MM_SS_f`` at its end)."""
    stamp = F.regexp_extract(_c(column), r"_(\d{10}_\d{2}_\d{2}_\d{1,6})$", 1)

    def time(stamp: Column) -> Column:
        padded = F.concat(F.substring(stamp, 1, 17),
                          F.rpad(F.substring(stamp, 18, 6), 6, "0"))
        return F.when(stamp != "", F.try_to_timestamp(padded, F.lit("MMddyyyyHH_mm_ss_SSSSSS")).cast("timestamp_ntz"))
    return _once(stamp, time)


def physio_file_psd(column: str | Column) -> Column:
    """The text between the first ``_`` and the recording time."""
    return F.regexp_extract(_c(column), r"^[^_]+_(.*)_\d{10}_\d{2}_\d{2}_\d{1,6}$", 1)


def like_pattern(value: str, star_wildcard: bool = False) -> str:
    return value.replace("*", "%") if star_wildcard else value


def normal_patient_id(column: str | Column) -> Column:
    return F.lower(F.btrim(_c(column), F.lit("/")))
