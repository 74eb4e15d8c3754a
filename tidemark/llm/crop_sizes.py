"""Crop and box sizes per source, campaign and builds, from sketches kept per build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import source_name
from tidemark.llm.quantiles import K, build_sketches, merge_sketches, percentiles, rank_error
from tidemark.operators.joins import lookup_join
from tidemark.session import Scratch

KEYS = ["campaign", "source", "definition", "build_no"]
GROUP = KEYS[:3]
FIRST_K, GROW, LAST_K = 512, 8, 1 << 20  # of the sketches that judge published sizes
SHARES = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def measurements(records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """campaign, source, definition, build_no, side: the shorter side of each crop and of each box, each crop_key once.

    A null, NaN or non-positive side is no measurement; a box has four numbers.
    Rows without a crop_key count as they stand.  wanted restricts them to the
    campaigns, sources and definitions it names, before anything is shuffled.
    """
    w, h = F.try_element_at("bbox", F.lit(3)), F.try_element_at("bbox", F.lit(4))
    def shorter(a, b):
        return F.when((a > 0) & (b > 0) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")), F.least(a, b).cast("double"))
    sides = records.select(
        "crop_key", "campaign", source_name("source").alias("source"), "build_no", shorter(F.col("native_width"), F.col("native_height")).alias("shard_native"), shorter(w, h).alias("ann_bbox")
    )
    if wanted is not None:
        sides = lookup_join(sides, wanted.select("campaign", "source").distinct(), ["campaign", "source"], "left_semi")
    once = sides.filter(F.col("crop_key").isNotNull()).dropDuplicates(["crop_key"]).unionByName(sides.filter(F.col("crop_key").isNull()))
    both = once.select("campaign", "source", "build_no", F.expr("stack(2, 'shard_native', shard_native, 'ann_bbox', ann_bbox) as (definition, side)"))
    if wanted is not None:
        both = lookup_join(both, wanted.select(*GROUP).distinct(), GROUP, "left_semi")
    return both.filter(F.col("side").isNotNull())


def sketches_per_build(spark: SparkSession, records: DataFrame, k: int = K, wanted: DataFrame | None = None) -> DataFrame:
    """The kept partial results: one sketch per campaign, source, definition and build, written to the shared folder.

    wanted restricts them to the campaigns, sources and definitions it names.
    """
    partials = build_sketches(measurements(records, wanted), KEYS, "side", k)
    return Scratch(spark, "sketches").save(merge_sketches(partials, KEYS, k), "builds")


def up_to_build(builds: DataFrame, wanted: DataFrame, k: int = K) -> DataFrame:
    """Percentiles of each wanted (campaign, source, definition, build_no) over its builds up to that one.

    Merges kept sketches only; no value is read again.
    """
    earlier = builds.withColumnRenamed("build_no", "b")
    parts = wanted.select(*KEYS).distinct().join(earlier, ["campaign", "source", "definition"]).filter(F.col("b") <= F.col("build_no"))
    return percentiles(merge_sketches(parts.drop("b"), KEYS, k), KEYS, SHARES, k)


def wrong_sizes(spark: SparkSession, records: DataFrame, published: DataFrame, tolerance: float = 0.2, k: int = FIRST_K) -> DataFrame:
    """Published groups of which a percentile differs by more than the tolerance from the recomputed one.

    A sketch decides where both of its rank bounds agree.  Groups whose bounds
    straddle the tolerance are sketched again with GROW times the k, up to
    LAST_K (rank error 8.5e-6), where the value itself decides; so it does in a
    sketch that never compacted, which is exact.  A published null counts as no statement, a group
    without measurements as wrong only if it states a number.
    """
    stated = published.withColumn("source", source_name("source")).select(*KEYS, *SHARES).distinct()
    wrong, open_ = None, stated
    while True:
        got = up_to_build(sketches_per_build(spark, records, k, None if wrong is None else open_), open_, k)
        judged = Scratch(spark, "judged").save(_judged(open_, got, tolerance, k), "groups")
        bad = judged.filter("wrong").select(*KEYS)
        wrong = bad if wrong is None else wrong.unionByName(bad)
        open_ = judged.filter(F.col("wrong").isNull()).select(*KEYS, *SHARES)
        if k >= LAST_K or not open_.limit(1).count():
            return wrong.select("campaign", "build_no", "source", "definition").distinct()
        k = min(LAST_K, GROW * k)


def _judged(stated: DataFrame, got: DataFrame, tolerance: float, k: int) -> DataFrame:
    """stated with wrong: true, false, or null where the bounds leave it open."""
    for x in SHARES:
        got = got.withColumnRenamed(x, f"{x}_is")

    def off(x, c):
        return F.abs(F.col(x) - c) > F.lit(tolerance) * c

    both = stated.join(got, KEYS, "left")
    surely, maybe, point = F.lit(False), F.lit(False), F.lit(False)
    for x in SHARES:
        low, high = F.col(f"{x}_low"), F.col(f"{x}_high")
        a, b = off(x, low), off(x, high)
        same_side = F.signum(F.col(x) - low) == F.signum(F.col(x) - high)
        missing = F.col(x).isNotNull() & F.col(f"{x}_is").isNull()
        surely |= F.coalesce(a & b & same_side, missing)
        maybe |= F.coalesce(a | b, F.lit(False))
        point |= F.coalesce(off(x, F.col(f"{x}_is")), missing)
    wrong = F.when(surely, F.lit(True)).when(~maybe, F.lit(False)).when(F.lit(k >= LAST_K) | (F.col("n") <= k), point)
    return both.select(*KEYS, *SHARES, wrong.alias("wrong"))


def rank_errors(spark: SparkSession, records: DataFrame, k: int) -> DataFrame:
    """campaign, source, definition, build_no, n and, for each percentile, whether its rank is within twice the stated error.

    The sketches of the builds are merged as for ``up_to_build``; the ranks come
    from counts over the values.
    """
    builds = sketches_per_build(spark, records, k)
    got = Scratch(spark, "got").save(up_to_build(builds, builds, k).select(*KEYS, "n", *SHARES), "percentiles")
    values = measurements(records).groupBy("campaign", "source", "definition", F.col("build_no").alias("b"), "side").agg(F.count("*").alias("c"))
    met = values.join(got, ["campaign", "source", "definition"]).filter(F.col("b") <= F.col("build_no"))
    sums = [F.sum(F.when(F.col("side") < F.col(x), F.col("c")).otherwise(0)).alias(f"{x}_less") for x in SHARES] + [F.sum(F.when(F.col("side") <= F.col(x), F.col("c")).otherwise(0)).alias(f"{x}_upto") for x in SHARES]
    ranks = met.groupBy(*KEYS, "n").agg(*sums)
    room = F.lit(2 * rank_error(k)) * F.col("n") + 1
    within = [((F.col(f"{x}_less") <= q * F.col("n") + room) & (F.col(f"{x}_upto") >= q * F.col("n") - room)).alias(x) for x, q in SHARES.items()]
    return ranks.select(*KEYS, "n", *within)
