"""Duplicates, references, set differences and report counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import placed


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of every key that occurs more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key no parent has."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def reconcile(expected: DataFrame, built: DataFrame, key: str, value: str) -> DataFrame:
    """status, n: missing, extra, differs or same, over distinct (key, value) of both sides."""
    a = expected.groupBy(key).agg(F.min(value).alias("a"))
    b = built.groupBy(key).agg(F.min(value).alias("b"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full_outer")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "differs").otherwise("same")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def finest_level(levels: list[Column]) -> Column:
    """The first level that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x.cast("string"), F.lit("")) for x in levels])


def presence(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """by, field, filled, distinct_values of each column, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(by, F.inline(pairs))
    return long.groupBy(by, "field").agg(F.count_if(F.coalesce("value", F.lit("")) != "").alias("filled"), F.count_distinct(F.nullif("value", F.lit(""))).alias("distinct_values"))


def top_or_other(df: DataFrame, column: str, k: int) -> DataFrame:
    """label, n: the k most frequent values and the rest as ``other`` (ties to the smaller value)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(k).select(column, F.lit(True).alias("top"))
    named = counts.join(F.broadcast(top), column, "left")  # k rows
    return named.groupBy(F.when(F.col("top"), F.col(column).cast("string")).otherwise("other").alias("label")).agg(F.sum("n").alias("n"))


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """column, code: values numbered from 0 in their order.

    The numbering is taken over the distinct values; rows join the codes.
    """
    levels = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return placed(levels, [], [column], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def upsert(held: DataFrame, new: DataFrame, key: str, id_column: str) -> DataFrame:
    """held plus those rows of new whose key it lacks, numbered on from its largest id in key order; running it again adds nothing."""
    fresh = placed(new.dropDuplicates([key]).join(held.select(key), key, "left_anti"), [], [key], "_n")
    start = held.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("start"))  # one row
    numbered = fresh.join(F.broadcast(start)).withColumn(id_column, (F.col("start") + F.col("_n")).cast(held.schema[id_column].dataType))
    return held.unionByName(numbered.select(*held.columns))
