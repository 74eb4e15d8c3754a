"""Consolidating pairwise matches into groups.

Method: vertices of degree one are stripped and chains of degree-two vertices
compressed, round after round, by list ranking through independent sets: in a
round every removable vertex whose priority beats its removable neighbours'
leaves, a leaf for its neighbour, a chain vertex for an edge between its two
neighbours.  The reduced core is solved by hooking and pointer jumping, and the
removed vertices get their labels back in reverse order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import url_name
from tidemark.operators.graph import both_ways, components
from tidemark.session import Scratch

ROUNDS = 12  # most reduction rounds; whatever remains is solved as the core
WORTH = 0.05  # a round after which a smaller share of the edges is gone is the last
AT_ONCE = 2  # rounds whose labels are restored per written table


def removable(edges: DataFrame, k: int) -> DataFrame:
    """Vertices (v, n1, n2) that leave in round k, with their neighbours.

    n2 is null for a leaf.  Removed vertices are never neighbours of each other.
    """
    ends = both_ways(edges)
    low = ends.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"), F.min("b").alias("n1"), F.max("b").alias("n2")).filter("degree <= 2")
    low = low.select("v", "n1", F.when(F.col("degree") == 2, F.col("n2")).alias("n2"))

    def priority(c: str):
        return F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c))

    rivals = low.select(F.col("v").alias("n"))
    near = low.select("v", F.explode(F.array_compact(F.array("n1", "n2"))).alias("n")).join(rivals, "n")
    beaten = near.filter(priority("n") > priority("v")).select("v").distinct()
    return low.join(beaten, "v", "left_anti")


def grouped(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the smallest vertex of its component.

    Null sides and loops do not link.  The smallest vertex may itself be removed
    and restored; the root is taken over all vertices at the end.
    """
    scratch = Scratch(edges.sparkSession, "matching")
    live = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = scratch.save(live, "live-0")
    left = live.count()
    taken: list[DataFrame] = []
    for k in range(rounds):
        if not left:
            break
        removed = scratch.save(removable(live, k), f"removed-{k}")
        gone = removed.select("v")
        rest = live.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
        bridges = removed.filter("n2 is not null").select(F.col("n1").alias("a"), F.col("n2").alias("b"))
        live = scratch.save(rest.union(bridges).distinct(), f"live-{k + 1}")
        scratch.drop(f"live-{k}")
        taken.append(removed)
        before, left = left, live.count()  # every vertex that leaves takes an edge with it
        if before - left < WORTH * before:
            break
    labels = components(live, "core").withColumnRenamed("root", "c")
    for k, removed in reversed(list(enumerate(taken))):
        # a neighbour without a label was left alone by the rounds after this one: it stands for its own component
        known = labels.select(F.col("v").alias("n"), "c")
        met = removed.select("v", F.col("n1").alias("n")).join(known, "n", "left")
        alone = F.when(F.col("c").isNull(), F.struct(F.col("n").alias("v"), F.col("n").alias("c")))
        restored = met.select(F.inline(F.array_compact(F.array(F.struct("v", F.coalesce("c", "n").alias("c")), alone))))
        # a vertex that a million neighbours found alone must not meet its next million in as many rows
        labels = labels.unionByName(restored.distinct())
        if k % AT_ONCE == 0:
            labels = scratch.save(labels, f"labels-{k}")
            for j in range(k, min(k + AT_ONCE, len(taken))):
                scratch.drop(f"removed-{j}")
            scratch.drop(f"labels-{k + AT_ONCE}")
    least = labels.groupBy("c").agg(F.min("v").alias("root"))
    return labels.join(least, "c").select("v", "root")


def image_groups(spark: SparkSession, images: DataFrame, matches: DataFrame) -> DataFrame:
    """(image_id, group_id) for the images of groups of two or more.

    URLs link whatever their spelling (scheme, host case, escapes, outer space);
    frames without an image link on.  group_id is the smallest image_id of the
    group.  Rows with a null side, or of a frame with itself, do not link;
    repeated images and matches count once; empty tables give no row.
    """
    scratch = Scratch(spark, "frames")
    links = matches.select(url_name("frame_url_a").alias("a"), url_name("frame_url_b").alias("b")).filter("a <> b")
    links = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    known = images.filter("image_id is not null").select(url_name("frame_url").alias("url"), "image_id").filter("url is not null").distinct()
    frames = links.select(F.explode(F.array("a", "b")).alias("url")).distinct().join(known, "url", "left")
    frames = scratch.save(frames, "frames")
    # a frame's number is its smallest image, or one above all images
    numbers = frames.groupBy("url").agg(F.min("image_id").alias("image_id"))
    numbers = scratch.save(numbers.select("url", F.coalesce("image_id", F.lit(1 << 62) + F.monotonically_increasing_id()).alias("n")), "numbers")
    ids = links.join(numbers.select(F.col("url").alias("a"), F.col("n").alias("na")), "a").join(numbers.select(F.col("url").alias("b"), F.col("n").alias("nb")), "b")
    roots = grouped(ids.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    members = frames.filter("image_id is not null").join(numbers, "url").join(roots.withColumnRenamed("v", "n"), "n").select("image_id", F.col("root").alias("group_id")).distinct()
    real = members.groupBy("group_id").agg(F.count("*").alias("size")).filter("size > 1").select("group_id")
    return members.join(real, "group_id").select("image_id", "group_id")
