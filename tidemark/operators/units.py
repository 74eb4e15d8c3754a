"""Counting usable species per group: units, gates and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, taxon: str, group: str, k: int, q: int) -> DataFrame:
    """taxon, total, largest: taxa with at least k + q rows and q of them outside their largest group."""
    per = rows.groupBy(taxon, group).agg(F.count("*").alias("n"))
    return per.groupBy(taxon).agg(F.sum("n").alias("total"), F.max("n").alias("largest")).filter((F.col("total") >= k + q) & (F.col("total") - F.col("largest") >= q))


def reference_ready(rows: DataFrame, taxon: str, group: str, k: int, groups: int) -> DataFrame:
    """taxon, total, groups: taxa with k rows in at least that many non-empty groups."""
    per = rows.groupBy(taxon).agg(F.count("*").alias("total"), F.count_distinct(F.nullif(F.col(group).cast("string"), F.lit(""))).alias("groups"))
    return per.filter((F.col("total") >= k) & (F.col("groups") >= groups))


def gate_sweep(rows: DataFrame, taxon: str, parent: str, group: str, crops: list[int], groups: list[int]) -> DataFrame:
    """min_crops, min_groups, species, genera2, genera3, species_in_genera2: what passes each pair of bars.

    The per-taxon counts are made once; the bars are a literal array per taxon,
    so the sweep costs one aggregate however many cells it has.
    """
    per = rows.groupBy(taxon, parent).agg(F.count("*").alias("n"), F.count_distinct(group).alias("g"))
    cells = F.array(*[F.struct(F.lit(c).alias("min_crops"), F.lit(g).alias("min_groups")) for c in crops for g in groups])
    passed = per.select(taxon, parent, "n", "g", F.inline(cells)).filter("n >= min_crops and g >= min_groups")
    by_parent = passed.groupBy("min_crops", "min_groups", parent).agg(F.count("*").alias("s"))
    return by_parent.groupBy("min_crops", "min_groups").agg(
        F.sum("s").alias("species"), F.count_if(F.col("s") >= 2).alias("genera2"), F.count_if(F.col("s") >= 3).alias("genera3"), F.sum(F.when(F.col("s") >= 2, F.col("s")).otherwise(0)).alias("species_in_genera2")
    )


def levels_material(taxa: DataFrame, levels: list[str]) -> DataFrame:
    """level, parents: parents with at least two children one level down, for each level above the first."""
    parts = None
    for child, parent in zip(levels, levels[1:], strict=False):
        part = taxa.groupBy(parent).agg(F.count_distinct(child).alias("c")).filter("c >= 2").agg(F.count("*").alias("parents")).select(F.lit(parent).alias("level"), "parents")
        parts = part if parts is None else parts.unionByName(part)
    return parts  # type: ignore[return-value]


def camera_units(rows: DataFrame, deployment: str, taxon: str, camera: str) -> DataFrame:
    """deployment, taxon, units: the larger count of the left and right camera."""
    left, right = F.count_if(F.col(camera) == "L"), F.count_if(F.col(camera) == "R")
    return rows.groupBy(deployment, taxon).agg(F.greatest(left, right).alias("units"))


def stereo_balance(rows: DataFrame, deployment: str, taxon: str, camera: str) -> DataFrame:
    """both, equal, within_tenth: deployment and taxon pairs seen by both cameras, by how their counts agree."""
    lr = rows.groupBy(deployment, taxon).agg(F.count_if(F.col(camera) == "L").alias("l"), F.count_if(F.col(camera) == "R").alias("r")).filter("l > 0 and r > 0")
    return lr.agg(F.count("*").alias("both"), F.count_if(F.col("l") == F.col("r")).alias("equal"), F.count_if(F.abs(F.col("l") - F.col("r")) <= F.greatest("l", "r") * 0.1).alias("within_tenth"))


def per_source_strength(rows: DataFrame, source: str, taxon: str, parent: str, group: str, crops: int, groups: int, genus_crops: int) -> DataFrame:
    """source, strong, genera: species over both bars, and genera with two species of genus_crops each."""
    per = rows.groupBy(source, parent, taxon).agg(F.count("*").alias("n"), F.count_distinct(group).alias("g"))
    by_parent = per.groupBy(source, parent).agg(F.count_if((F.col("n") >= crops) & (F.col("g") >= groups)).alias("strong"), F.count_if(F.col("n") >= genus_crops).alias("wide"))
    return by_parent.groupBy(source).agg(F.sum("strong").alias("strong"), F.count_if(F.col("wide") >= 2).alias("genera"))


def shared_between(rows: DataFrame, source: str, taxon: str) -> DataFrame:
    """source_a, source_b, shared: taxa that both of two sources have (a < b)."""
    sets = rows.groupBy(taxon).agg(F.array_sort(F.collect_set(source)).alias("s"))  # at most one element per source
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
    return sets.select(F.inline(pairs)).groupBy("source_a", "source_b").agg(F.count("*").alias("shared"))


def children_list(taxa: DataFrame, parent: str, taxon: str, weight: Column, least: int) -> DataFrame:
    """parent, n, listed: its taxa of at least that weight, heaviest first, joined by a bar."""
    per = taxa.groupBy(parent, taxon).agg(weight.alias("w")).filter(F.col("w") >= least)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), F.col(taxon).alias("t"))))  # children of one parent
    return per.groupBy(parent).agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["t"].cast("string")), "|").alias("listed"))


def transfer_pools(rows: DataFrame, taxon: str, group: str, source: str, k: int, q: int, groups: int) -> DataFrame:
    """source_a, source_b, taxa: taxa ready as reference in a and as query in b.

    A query source needs q rows; with a = b they must lie outside the largest group.
    """
    ref = rows.groupBy(source, taxon).agg(F.count("*").alias("n"), F.count_distinct(group).alias("g")).filter((F.col("n") >= k) & (F.col("g") >= groups)).select(F.col(source).alias("source_a"), taxon)
    per = rows.groupBy(source, taxon, group).agg(F.count("*").alias("c")).groupBy(source, taxon).agg(F.sum("c").alias("n"), F.max("c").alias("m"))
    query = per.filter(F.col("n") >= q).select(F.col(source).alias("source_b"), taxon, "n", "m")
    both = ref.join(query, taxon).filter((F.col("source_a") != F.col("source_b")) | ((F.col("n") >= k + q) & (F.col("n") - F.col("m") >= q)))
    return both.groupBy("source_a", "source_b").agg(F.count_distinct(taxon).alias("taxa"))
