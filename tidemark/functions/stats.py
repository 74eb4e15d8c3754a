"""Percentile definitions and test statistics.

The definitions differ on purpose and are not interchangeable; q is a share, the
values are sorted and numbered from 0 to n - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import total_before


def _position(kind: str, n: Column, q: float) -> Column:
    return {
        "nearest": F.rint(F.lit(q) * (n - 1)),
        "scaled": F.least(n - 1, F.floor(F.lit(q) * n)),
        "lower": F.floor(F.lit(q) * (n - 1)),
        "tenth": F.floor(n * int(q * 10) / 10),
    }[kind].cast("long")


def percentile_table(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys, n, linear, nearest, scaled, lower, tenth: five definitions of one percentile.

    linear interpolates at q (n - 1); nearest is the value at round(q (n - 1)),
    scaled at int(q n), lower at int(q (n - 1)), tenth at n * (10 q) // 10.
    Equal values are counted first, so a task orders distinct values only and a
    group with a third of all rows is no larger than its distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy(*keys))
    placed = counts.withColumn("upto", upto).withColumn("n", n)

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("v")))

    low = F.floor(F.lit(q) * (F.col("n") - 1))
    high = F.least(F.col("n") - 1, low + 1)
    found = placed.groupBy(*keys).agg(F.first("n").alias("n"), at(low).alias("_lo"), at(high).alias("_hi"), *[at(_position(k, F.col("n"), q)).alias(k) for k in ("nearest", "scaled", "lower", "tenth")])
    part = F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return found.select(*keys, "n", F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part, 6).alias("linear"), "nearest", "scaled", "lower", "tenth")


def auc(rows: DataFrame, value: str, positive: str) -> DataFrame:
    """auc, folded, n_positive, n_negative: Mann-Whitney with ties counted half.

    Works on counts of distinct values, whose running totals come from ranges.
    """
    counts = rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("q"))
    below = total_before(counts, [], ["v"], F.col("q"), "below")
    s = below.withColumn("wins", F.col("p") * (F.col("below") + F.col("q") / 2)).agg(F.sum("wins").alias("w"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    a = F.round(F.try_divide("w", F.col("np") * F.col("nq")), 6)
    return s.select(a.alias("auc"), F.greatest(a, 1 - a).alias("folded"), F.col("np").cast("long").alias("n_positive"), F.col("nq").cast("long").alias("n_negative"))


def average_rank(order: Column, over: list[str]) -> Column:
    """Rank from 1 with ties averaged."""
    w = Window.partitionBy(*over).orderBy(order)
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """keys, n, rho: rank correlation with averaged ties; null under ``least`` pairs."""
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.withColumn("rx", average_rank(F.col(x), keys)).withColumn("ry", average_rank(F.col(y), keys))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
    return g.select(*keys, "n", F.when(F.col("n") >= least, F.round("rho", 6)).alias("rho"))


def t_quantile(spark, p: float, df: int) -> float:
    """Quantile of Student's t, from the mathematics library that Spark ships."""
    return spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution(float(df)).inverseCumulativeProbability(p)
