"""Natural ordering of listing cells: digit runs compare as numbers and come before text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.text import _c

_HEX = r"(?i)^0x[0-9a-f]+$"
_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"


def natural_key(column: str | Column, insensitive: bool = False) -> Column:
    """struct(lane, tokens): hex numbers and dates share a numeric lane; numbers are one token; other text is split in runs.

    A cell is a number if the whole of it casts to double and ends in a digit or a point, so 1e5, -2.50 and +3 are, and
    1d, 12px, NaN and Infinity are not. Listings of other tools may read a trailing width letter or a cut-off exponent
    as part of a number; here such cells are text.
    """
    text = F.trim(_c(column))
    if insensitive:
        text = F.lower(text)
    hexed = F.when(text.rlike(_HEX), F.conv(F.substring(text, 3, 1 << 30), 16, 10).cast("double"))
    day = F.try_to_timestamp(F.when(text.rlike(_DATE), F.regexp_extract(text, "(" + _DATE + ")", 1)),
                             F.lit("yyyy-M-d"))
    dated = F.unix_timestamp(day).cast("double")
    whole = F.when(text.rlike(r"[0-9.]$"), text.try_cast("double"))
    token = lambda number, string: F.struct(
        F.when(number.isNull(), 1).otherwise(0).alias("text"), F.coalesce(number, F.lit(0.0)).alias("number"),
        string.alias("string"))
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1),
                       lambda t: token(F.when(t.rlike(r"^[0-9]"), t.cast("double")), t))
    tokens = F.when(whole.isNotNull(), F.array(token(whole, text))).otherwise(runs)
    return F.struct(F.coalesce(hexed, dated).alias("lane"), tokens.alias("tokens"))


def natural_order(column: str | Column, descending: bool = False, insensitive: bool = False) -> list[Column]:
    """Sort columns for ``orderBy``: rows with a lane value last, as plain text sorts before them."""
    key = natural_key(column, insensitive)
    lane, tokens = key["lane"], key["tokens"]
    if descending:
        return [lane.desc_nulls_last(), tokens.desc()]
    return [lane.asc_nulls_first(), tokens.asc()]
