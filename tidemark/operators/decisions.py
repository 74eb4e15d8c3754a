"""Choosing between candidates from scored draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import spearman


def summarise(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, low, high, sd, n of the value (sample standard deviation)."""
    return results.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"), F.round(F.stddev_samp(value), 6).alias("sd"), F.count(value).alias("n"))


def two_stage_mean(results: DataFrame, keys: list[str], inner: str, value: str) -> DataFrame:
    """keys, mean: the mean over ``inner`` of the means within it."""
    return results.groupBy(*keys, inner).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.round(F.avg("m"), 6).alias("mean"))


def axis_range(results: DataFrame, axis: str, value: str) -> DataFrame:
    """axis, spread: how far the means of an axis' settings lie apart."""
    return results.groupBy(axis).agg(F.avg(value).alias("m")).agg(F.lit(axis).alias("axis"), F.round(F.max("m") - F.min("m"), 6).alias("spread"))


def decide(draws: DataFrame, level: str, candidate: str, draw: str, value: str, t_critical: float) -> DataFrame:
    """level, candidate, mean, best, tied: the best candidate per level and those not significantly worse.

    Paired over draws, one-sided: worse if mean difference / (sd / sqrt(n))
    exceeds the critical value; with sd 0 if the mean is above 0; never with
    fewer than two draws.  Ties of the mean go to the smaller candidate.
    """
    mean = draws.groupBy(level, candidate).agg(F.avg(value).alias("m"))
    rank = F.row_number().over(Window.partitionBy(level).orderBy(F.desc(F.round("m", 9)), candidate))
    best = mean.withColumn("rn", rank).filter("rn = 1").select(level, F.col(candidate).alias("best"))
    top = draws.join(best, level).filter(F.col(candidate) == F.col("best")).select(level, draw, F.col(value).alias("_v"), "best")
    d = draws.join(top, [level, draw]).withColumn("d", F.round(F.col("_v") - F.col(value), 9))
    s = d.groupBy(level, candidate, "best").agg(F.avg(value).alias("mean"), F.avg("d").alias("md"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n"))
    worse = F.when(F.col("n") < 2, F.lit(False)).when(F.coalesce("sd", F.lit(0.0)) < 1e-12, F.col("md") > 1e-12).otherwise(F.col("md") / (F.col("sd") / F.sqrt("n")) > t_critical)
    return s.select(level, candidate, F.round("mean", 6).alias("mean"), "best", (~worse).alias("tied"))


def winner(decided: DataFrame, level: str, candidate: str) -> DataFrame:
    """candidate, overall, levels_tied: the best mean over the levels, and on how many it is among the best."""
    per = decided.groupBy(candidate).agg(F.round(F.avg("mean"), 6).alias("overall"), F.count_if("tied").alias("levels_tied"))
    return per.orderBy(F.desc("overall"), candidate).limit(1)


def decide_cases(decided: DataFrame, level: str, candidate: str) -> DataFrame:
    """candidate, case, role, best_at of what is kept after ``decide``.

    The winner has the best mean over the levels.  Case 1: it is among the best
    at every level and stands alone.  Case 2: it falls short at some, and the best
    candidate of each of these is kept too, with the levels it was kept for.
    """
    top = winner(decided, level, candidate).select(F.col(candidate).alias("winner"))
    each = decided.join(F.broadcast(top))  # one row
    short = each.filter((F.col(candidate) == F.col("winner")) & ~F.col("tied")).select(level, F.col("best").alias(candidate))
    best_at = decided.filter(F.col(candidate) == F.col("best")).groupBy(candidate).agg(F.concat_ws("+", F.array_sort(F.collect_set(F.col(level).cast("string")))).alias("best_at"))  # as many as levels
    others = short.groupBy(candidate).agg(F.concat(F.lit("best at "), F.concat_ws("+", F.array_sort(F.collect_set(F.col(level).cast("string"))))).alias("role"))
    kept = top.select(F.col("winner").alias(candidate), F.lit("winner").alias("role")).unionByName(others.join(F.broadcast(top), F.col(candidate) == F.col("winner"), "left_anti"))
    case = short.agg(F.when(F.count("*") > 0, 2).otherwise(1).alias("case"))  # one row
    return kept.join(best_at, candidate, "left").join(F.broadcast(case)).select(candidate, "case", "role", F.coalesce("best_at", F.lit("none")).alias("best_at"))


def stability(results: DataFrame, condition: str, base: object, level: str, candidate: str, draw: str, value: str, chosen: object, t_critical: float) -> DataFrame:
    """condition, level, holds, chosen_mean, best, n, rho: whether the chosen candidate is among the best under each other condition.

    rho is the rank correlation of the candidates' means with those under
    ``base`` (null under three common ones); conditions that lack the chosen
    candidate at a level give no row for it.
    """
    others = results.filter(F.col(condition) != base)
    keyed = others.withColumn("_at", F.struct(condition, level))
    ties = decide(keyed, "_at", candidate, draw, value, t_critical).select("_at.*", candidate, F.col("mean"), "best", "tied")
    own = ties.filter(F.col(candidate) == chosen)
    mean = results.groupBy(condition, level, candidate).agg(F.avg(value).alias("_m"))
    first = mean.filter(F.col(condition) == base).select(level, candidate, F.col("_m").alias("_x"))
    rho = spearman(mean.filter(F.col(condition) != base).join(first, [level, candidate]), [condition, level], "_x", "_m")
    out = own.join(rho, [condition, level], "left")
    return out.select(condition, level, F.col("tied").alias("holds"), F.col("mean").alias("chosen_mean"), "best", F.coalesce("n", F.lit(0)).alias("n"), "rho")


def axis_ranges(results: DataFrame, axes: list[str], value: str, layer: str, pooled: str = "pooled") -> DataFrame:
    """axis, spread of every axis; the pooled layer, which has no place on the layer axis, counts for none."""
    rows = results.filter(F.coalesce(F.col(layer).cast("string") != pooled, F.lit(True)))
    return reduce(DataFrame.unionByName, [axis_range(rows, a, value) for a in axes])


def check_spec(spec: DataFrame, scored: DataFrame, decided: DataFrame, geometries: DataFrame) -> DataFrame:
    """problem, backbone, token, layer, geometry: what a list of kept readouts and a sweep do not agree on.

    spec, decided: (backbone, size, token, layer); scored adds geometry;
    geometries (backbone, geometry) are those that must be scored.
    unscored: a kept readout lacks a geometry; other_size: a decision at another
    size; not_kept: a decision that the list lacks; beyond (no fault): a kept
    readout without a decision; dropped (no fault): a backbone that the list lacks.
    """
    name = ["backbone", "token", "layer"]
    due = spec.join(geometries, "backbone")
    unscored = due.join(scored, [*name, "size", "geometry"], "left_anti").select(F.lit("unscored").alias("problem"), *name, "geometry")
    none = F.lit(None).cast("string").alias("geometry")
    sizes = spec.select("backbone", F.col("size").alias("_s")).distinct()
    listed = decided.join(sizes, "backbone")
    other = listed.filter(F.col("size") != F.col("_s")).select(F.lit("other_size").alias("problem"), *name, none)
    not_kept = listed.join(spec, name, "left_anti").select(F.lit("not_kept").alias("problem"), *name, none)
    beyond = spec.join(decided, name, "left_anti").select(F.lit("beyond").alias("problem"), *name, none)
    dropped = decided.join(sizes, "backbone", "left_anti").select(F.lit("dropped").alias("problem"), *name, none)
    return reduce(DataFrame.unionByName, [unscored, other, not_kept, beyond, dropped]).distinct()


def kept_provenance(spec: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of spec (backbone, size, token, layer) with why: decision, or re-plan where none kept them."""
    name = ["backbone", "token", "layer"]
    return spec.join(decided.select(*name, F.lit("decision").alias("_w")).distinct(), name, "left").select("backbone", "size", "token", "layer", F.coalesce("_w", F.lit("stability re-plan")).alias("why"))
