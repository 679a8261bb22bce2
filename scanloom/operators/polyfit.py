"""Least-squares polynomials per group from power sums (degree up to 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polyfit(df: DataFrame, by: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """Fit y on x per group: columns ``center``, ``scale`` and the fit in an orthogonal basis.

    x is centred at the group mean and scaled by its standard deviation, then one aggregation takes the power
    sums; the orthogonal polynomials and their weights follow in closed form. Evaluate with ``polyval``.
    """
    if not 1 <= degree <= 3:
        raise ValueError("degree 1 to 3")
    by = list(by)
    spread = df.groupBy(*by).agg(F.avg(x).alias("center"), F.stddev_pop(x).alias("_s"))
    spread = spread.select(*by, "center", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("scale"))
    u = (F.col(x) - F.col("center")) / F.col("scale")
    m = df.join(spread, by).withColumn("_u", u)
    power = lambda k: F.pow(F.col("_u"), F.lit(float(k)))
    sums = m.groupBy(*by, "center", "scale").agg(
        *[F.sum(power(k)).alias(f"m{k}") for k in range(0, 7)],
        *[F.sum(F.col(y) * power(k)).alias(f"c{k}") for k in range(0, 4)])
    c = F.col
    out = sums.withColumn("a2", c("m3") / c("m2")).withColumn("b2", c("m2") / c("m0"))
    out = (out.withColumn("h2", c("m4") - c("m3") * c("a2") - c("m2") * c("b2"))
           .withColumn("g2", c("m5") - c("a2") * c("m4") - c("b2") * c("m3")))
    out = out.withColumn("a3", c("g2") / c("h2")).withColumn("b3", c("m4") / c("m2")).withColumn("d3", c("m3") / c("m0"))
    out = out.withColumn("h3", c("m6") - c("g2") * c("a3") - c("m4") * c("b3") - c("m3") * c("d3"))
    p2 = c("c2") - c("a2") * c("c1") - c("b2") * c("c0")
    p3 = c("c3") - c("a3") * p2 - c("b3") * c("c1") - c("d3") * c("c0")
    zero = F.lit(0.0)
    return out.select(*by, "center", "scale", "a2", "b2", "a3", "b3", "d3",
                      (c("c0") / c("m0")).alias("w0"), (c("c1") / c("m2")).alias("w1"),
                      ((p2 / c("h2")) if degree > 1 else zero).alias("w2"), ((p3 / c("h3")) if degree > 2 else zero).alias("w3"))


def polyval(x: Column) -> Column:
    """Value of the fit whose columns are in the row."""
    c = F.col
    u = (x - c("center")) / c("scale")
    p2 = u * u - c("a2") * u - c("b2")
    p3 = u * u * u - F.coalesce("a3", F.lit(0.0)) * p2 - c("b3") * u - c("d3")
    return c("w0") + c("w1") * u + c("w2") * p2 + F.when(c("w3") != 0, c("w3") * p3).otherwise(0.0)


def detrend(df: DataFrame, by: Sequence[str], x: str, y: str, degree: int, name: str) -> DataFrame:
    """``y`` minus its polynomial trend in ``x``."""
    by = list(by)
    fit = polyfit(df, by, x, y, degree)
    columns = df.columns
    return df.join(fit, by).withColumn(name, F.col(y) - polyval(F.col(x))).select(*columns, name)
