"""Samples, draws and shares without a random number stream.

Every shuffle is an order by SHA-256 of seed and key, so results are the same in
any partitioning and can be recomputed by an independent engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import hash_order
from tidemark.operators.ranks import placed
from tidemark.operators.units import usable
from tidemark.session import Scratch


def ranked(rows: DataFrame, group: list[str], key: str, seed: str) -> DataFrame:
    """rows with rn, their place in the group's hash order."""
    return placed(rows, group, [hash_order(F.lit(seed), F.col(key)), key])


def take_per_group(rows: DataFrame, group: list[str], key: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each group; every task drops what is beyond n before anything is shuffled."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(hash_order(F.lit(seed), F.col(key)), key))
    return rows.withColumn("rn", rn).filter(F.col("rn") <= n).drop("rn")


def stratified(rows: DataFrame, group: list[str], key: str, fraction: float, seed: str) -> DataFrame:
    """rint(fraction * size) rows of each group; a null group is one."""
    sizes = rows.groupBy(*group).agg(F.rint(F.count("*") * fraction).alias("_quota")).select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(group)], "_quota")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_s{i}")) for i, g in enumerate(group)])
    return ranked(rows, group, key, seed).join(sizes, same).filter(F.col("rn") <= F.col("_quota")).select(*rows.columns)


def stride(rows: DataFrame, group: list[str], order: list[str], step: int) -> DataFrame:
    """Every step-th row of each group, the first included."""
    return placed(rows, group, order).filter(F.pmod(F.col("rn") - 1, F.lit(step)) == 0).drop("rn")


def take_until(rows: DataFrame, taxon: str, group: str, k: int, seed: str) -> DataFrame:
    """taxon, group, n, role: groups in hash order go to the reference until it has k rows, the rest are queries."""
    per = rows.groupBy(taxon, group).agg(F.count("*").alias("n"))
    order = hash_order(F.lit(seed), F.col(taxon), F.col(group))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(taxon).orderBy(order, group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("before", before).withColumn("role", F.when(F.col("before") < k, "reference").otherwise("query")).select(taxon, group, "n", "role")


def draw_sides(rows: DataFrame, taxon: str, group: str, k: int, q: int, n_draws: int, tries: int, seed: str) -> DataFrame:
    """draw, taxon, try_no, group, role: the sides of the first try with k reference rows that leaves q queries.

    Tries are laid out on the few (taxon, group) counts, in rounds that grow;
    a round meets only the draws that no earlier one settled.  Taxa whose
    counts rule out any order are not tried.
    """
    scratch = Scratch(rows.sparkSession, "draws")
    per = rows.filter(F.col(taxon).isNotNull()).groupBy(taxon, group).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(taxon)
    able = per.withColumn("total", F.sum("n").over(whole)).withColumn("rest", F.col("total") - F.max("n").over(whole)).filter((F.col("total") >= k + q) & (F.col("rest") >= min(k, q))).drop("rest")
    left = able.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    order = hash_order(F.lit(seed), F.col("draw"), F.col("try_no"), F.col(taxon), F.col(group))
    one = Window.partitionBy("draw", taxon, "try_no")
    before = F.coalesce(F.sum("n").over(one.orderBy(order, group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    refs = F.sum(F.when(F.col("role") == "reference", F.col("n"))).over(one)
    first = F.min(F.when((F.col("refs") >= k) & (F.col("total") - F.col("refs") >= q), F.col("try_no"))).over(Window.partitionBy("draw", taxon))
    sides, low = None, 0
    while True:
        high = min(tries, 8 * low or 1)
        laid = left.repartition("draw", taxon).withColumn("try_no", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        laid = laid.withColumn("role", F.when(before < k, "reference").otherwise("query")).withColumn("refs", refs).withColumn("first", first)
        settled = scratch.save(laid.filter("try_no = first").select("draw", taxon, "try_no", group, "role"), f"sides-{low}")
        sides = settled if sides is None else sides.unionByName(settled)
        if high == tries:
            return sides
        left = scratch.save(left.join(settled.select("draw", taxon).distinct(), ["draw", taxon], "left_anti"), f"left-{low}")
        if not left.limit(1).count():
            return sides
        low = high


def draws(rows: DataFrame, taxon: str, group: str, key: str, k: int, q: int, n_draws: int, tries: int, seed: str) -> DataFrame:
    """draw, taxon, try_no, group, key, role, ref_rank: per draw the first try that leaves q queries.

    Only the chosen try meets the rows.  The reference is the first k rows in
    hash order, so a smaller k is a prefix of it; whole groups are on one side.
    ``failed_draws`` names the taxa that no try fits.
    """
    members = rows.select(taxon, group, key).join(draw_sides(rows, taxon, group, k, q, n_draws, tries, seed), [taxon, group])
    rn = F.row_number().over(Window.partitionBy("draw", taxon).orderBy(hash_order(F.lit(seed), F.col("draw"), F.col(key)), key))
    reference = members.filter("role = 'reference'").withColumn("ref_rank", rn).filter(F.col("ref_rank") <= k)
    queries = members.filter("role = 'query'").withColumn("ref_rank", F.lit(None).cast("int"))
    return reference.unionByName(queries).select("draw", taxon, "try_no", group, key, "role", "ref_rank")


def failed_draws(rows: DataFrame, taxon: str, group: str, k: int, q: int, n_draws: int, tries: int, seed: str) -> DataFrame:
    """taxon, draws: usable taxa with the number of their draws that no try fits."""
    made = draw_sides(rows, taxon, group, k, q, n_draws, tries, seed).groupBy(taxon).agg(F.count_distinct("draw").alias("made"))
    short = F.lit(n_draws) - F.coalesce("made", F.lit(0))
    return usable(rows, taxon, group, k, q).join(made, taxon, "left").select(taxon, short.alias("draws")).filter("draws > 0")


def match_shape(rows: DataFrame, side: str, first: object, second: object, bin_: Column, key: str, seed: str) -> DataFrame:
    """rows of both sides cut to one common shape over the bins.

    The shape is the smaller share of each bin, rescaled; each side keeps the
    most rows that fit it, int(n * p + 1e-9) of each bin in hash order.
    """
    binned = rows.filter(F.col(side).isin(first, second)).withColumn("bin", bin_)
    counts = binned.groupBy("bin").agg(F.count_if(F.col(side) == first).cast("double").alias("ca"), F.count_if(F.col(side) == second).cast("double").alias("cb"))
    whole = counts.agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    p = counts.join(F.broadcast(whole)).withColumn("p", F.least(F.col("ca") / F.col("na"), F.col("cb") / F.col("nb"))).filter("p > 0")  # one row joins the bins
    total = p.agg(F.sum("p").alias("s"))
    p = p.join(F.broadcast(total)).withColumn("p", F.col("p") / F.col("s"))
    fit = p.agg(F.min(F.col("ca") / F.col("p")).alias("fa"), F.min(F.col("cb") / F.col("p")).alias("fb"))
    quota = p.join(F.broadcast(fit)).select("bin", F.least("ca", F.floor(F.col("fa") * F.col("p") + 1e-9)).alias("qa"), F.least("cb", F.floor(F.col("fb") * F.col("p") + 1e-9)).alias("qb"))
    placed = ranked(binned, [side, "bin"], key, seed).join(F.broadcast(quota), "bin")  # as many rows as bins
    return placed.filter(F.col("rn") <= F.when(F.col(side) == first, F.col("qa")).otherwise(F.col("qb"))).select(*rows.columns, "bin")


def quota_greedy(rows: DataFrame, image: str, concept: str, cap: int) -> DataFrame:
    """image, kept: images in order of their rarest concept, kept while any of their concepts is below cap.

    Each decision depends on all earlier ones, so the images pass through one
    task in order; only (image, concept) pairs go there, two numbers each, and
    the task streams them in sorted batches.
    """
    import pandas as pd

    total = rows.groupBy(concept).agg(F.count("*").alias("total"))
    pairs = rows.select(image, concept).distinct().join(total, concept)
    rare = F.min("total").over(Window.partitionBy(image))
    ordered = pairs.withColumn("rare", rare).repartition(1).sortWithinPartitions("rare", image, concept)

    def run(frames):
        have: dict = {}
        current, own = None, []

        def settle():
            keep = any(have.get(c, 0) < cap for c in own)
            if keep:
                for c in own:
                    have[c] = have.get(c, 0) + 1
            return current, keep

        for frame in frames:
            out = []
            for i, c in zip(frame[image], frame[concept], strict=True):
                if current is not None and i != current:
                    out.append(settle())
                    own = []
                current = i
                own.append(c)
            yield pd.DataFrame(out, columns=[image, "kept"])
        if current is not None:
            yield pd.DataFrame([settle()], columns=[image, "kept"])

    kind = dict(rows.dtypes)[image]
    return ordered.select(image, concept).mapInPandas(run, f"`{image}` {kind}, kept boolean")
