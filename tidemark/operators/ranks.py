"""Places of rows in the order of their group, also where one group is too large for a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch

GROUP_ROWS = 2_000_000  # most rows of a group that one task orders


def placed(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """rows with their place, from 1, in the ascending order of their group (nulls first; a null key is a group).

    The largest group is counted.  Where it fits a task, a window orders each
    group; beyond that all rows are cut into ranges of (group, order), which the
    exact counts of the ranges before put in place, so no task orders more than
    a range.  Rows that are equal in ``order`` have an arbitrary but single order.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for k, o in zip(keys, order, strict=True)])
    hot = rows.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > GROUP_ROWS).limit(1).count()
    if not hot:
        return keyed.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*keys))).drop(*keys)
    scratch = Scratch(rows.sparkSession, "placed")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    cut = scratch.save(keyed.repartitionByRange(tasks, *group, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), before.alias("_before"))  # a row per group and range that has it
    within = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*keys)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return within.join(starts, same).select(*rows.columns, (F.col("_before") + F.col("_rn")).cast("long").alias(name))


RANGE_ROWS = 100_000  # rows whose running total one task takes


def total_before(rows: DataFrame, group: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """rows with the sum of ``value`` over the rows before them in the ascending order of their group (0 for the first).

    Sums of RANGE_ROWS places each come first, then those within a range; a null
    value counts as 0, a null key is a group.
    """
    at = placed(rows, group, order, "_rn").withColumn("_range", F.floor((F.col("_rn") - 1) / RANGE_ROWS)).withColumn("_value", F.coalesce(value, F.lit(0)))
    sums = at.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), before.alias("_before"))
    within = F.coalesce(F.sum("_value").over(Window.partitionBy(*group, "_range").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_r"))
    return at.withColumn("_within", within).join(starts, same).select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))


def percentile(rows: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """group and the q-th percentile of a value, linear between the two places around it; null values do not count.

    The two values are picked by their places, so no task holds a group's values.
    """
    own = rows.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    sizes = own.groupBy(*group).agg(F.count("*").alias("_n")).select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], ((F.col("_n") - 1) * F.lit(q)).alias("_at"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)], F.lit(True))
    met = placed(own, group, ["_v"], "_rn").join(sizes, same).filter((F.col("_rn") - 1).isin(F.floor("_at"), F.ceil("_at")))
    part = F.max("_at") - F.floor(F.max("_at"))
    return met.groupBy(*group).agg((F.min("_v") + (F.max("_v") - F.min("_v")) * part).alias(name))
