"""Ordered computation without ordered groups in one task.

* ``running_total`` / ``row_numbers``: exact prefix sums over any total order. Rows are range-partitioned on
  the whole key, so a key owning a third of the table spreads over a third of the tasks; only one row per
  (range, group) travels to compute the carry.
* ``near``: fixed-distance neighbours (lag, lead, short convolutions) on a dense integer index. Each row is
  sent to its own block and, near an edge, to the next one; every window group has a fixed maximum size.
* ``group_median``: exact median from running totals over distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import cut_lineage


def _range_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str = "total",
                  ranges: int | None = None, how: str = "sum") -> DataFrame:
    """Add ``name``: the sum (or ``how="max"``: the maximum) of ``amount`` over this and all earlier rows.

    ``order`` must be a total order inside each group. The range numbering is written out once, because
    the totals per range and the rows themselves must agree on it even when a task is repeated.
    """
    by, order = list(by), list(order)
    n = ranges or _range_count(df)
    fold = F.sum if how == "sum" else F.max
    placed = (df.withColumn("_amount", amount).repartitionByRange(n, *by, *order)
              .withColumn("_range", F.spark_partition_id()))
    placed = cut_lineage(placed)
    sums = placed.groupBy("_range", *by).agg(fold("_amount").alias("_sum"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = sums.select("_range", *by, fold("_sum").over(before).alias("_carry"))
    if not by:
        carry = F.broadcast(carry)  # one row per range: at most ``n`` rows
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_local", fold("_amount").over(inside))
    joined = (F.coalesce(F.col("_carry"), F.lit(0)) + F.col("_local") if how == "sum"
              else F.greatest("_carry", "_local"))  # greatest skips NULLs
    keys = F.lit(True)
    for key in ["_range", *by]:
        keys = keys & local[key].eqNullSafe(carry[key])
    return (local.join(carry, keys).select(*[local[c] for c in local.columns], "_carry")
            .withColumn(name, joined).drop("_range", "_carry", "_local", "_amount"))


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_number",
                ranges: int | None = None) -> DataFrame:
    """1, 2, 3 … per group in the given total order."""
    return running_total(df, by, order, F.lit(1).cast("long"), name, ranges)


def group_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values for an even count)."""
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, by, [value], F.col("_n"), "_upto")
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    low = F.floor((F.col("_size") + 1) / 2)
    high = F.floor(F.col("_size") / 2) + 1
    holds = lambda position: (F.col("_upto") - F.col("_n") < position) & (F.col("_upto") >= position)
    joined = placed.join(sizes, by).where(holds(low) | holds(high))
    return joined.groupBy(*by).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(name))


def near(df: DataFrame, by: Sequence[str], index: str, before: int, after: int,
         columns: Callable[[Window], dict[str, Column]], block: int = 4096) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``index`` is a dense integer position inside each group. ``columns`` gets an ordered window over one
    block (at most ``block + before + after`` rows) and returns the new columns.
    """
    i, b = F.col(index), F.lit(block)
    own = F.floor(i / b)
    places = F.array_distinct(F.array(F.floor((i - after) / b), own, F.floor((i + before) / b)))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(places))
    window = Window.partitionBy(*by, "_block").orderBy(index)
    for name, column in columns(window).items():
        spread = spread.withColumn(name, column)
    return spread.where("_block = _own").drop("_block", "_own")


def chunked_lists(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "items",
                  chunk: int = 10_000) -> DataFrame:
    """Ordered values per group as lists of at most ``chunk`` items; ``part`` 0, 1, … numbers a group's lists."""
    numbered = row_numbers(df, by, order, "_n").withColumn("part", F.floor((F.col("_n") - 1) / chunk))
    packed = numbered.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_items"))
    return packed.withColumn(name, F.transform("_items", lambda i: i[value])).drop("_items")


def previous(df: DataFrame, by: Sequence[str], index: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``value`` of the row one position earlier on a dense index (NULL for the first)."""
    return near(df, by, index, 1, 0, lambda w: {name: F.lag(value, 1).over(w)}, block)


def difference(df: DataFrame, by: Sequence[str], index: str, value: str, name: str, first: str = "zero",
               block: int = 4096) -> DataFrame:
    """First difference on a dense index; the first row gets 0 or (``first='repeat'``) the next difference."""
    def columns(w):
        step = F.col(value) - F.lag(value, 1).over(w)
        ahead = F.lead(value, 1).over(w) - F.col(value)
        return {name: F.coalesce(step, ahead if first == "repeat" else F.lit(0.0))}
    return near(df, by, index, 1, 1, columns, block)


def convolve(df: DataFrame, by: Sequence[str], index: str, value: str, kernel: Column, name: str) -> DataFrame:
    """Causal convolution with an array-valued ``kernel`` column, truncated to the input's length.

    Every sample adds ``kernel[k] * value`` to position ``index + k``; the sums combine before the shuffle
    and their key is (group, position), so no group is large.
    """
    by = list(by)
    parts = df.select(*by, F.col(index).alias("_i"), F.col(value).alias("_v"),
                      F.posexplode(kernel).alias("_k", "_c"))
    sums = parts.groupBy(*by, (F.col("_i") + F.col("_k")).alias(index)).agg(
        F.sum(F.col("_v") * F.col("_c")).alias(name))
    return df.join(sums, [*by, index], "left")
