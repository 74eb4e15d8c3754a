"""Connected components by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) in both directions; the two sides of a pair stay in one scan."""
    pairs = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.inline(pairs))


def jump(scratch: Scratch, parents: DataFrame, tag: str) -> DataFrame:
    """Shortens (v, p) until every p is a root, by repeatedly replacing p with its own p."""
    step = 0
    while True:
        upper = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
        nearer = parents.join(upper, "p", "left").select("v", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved"))
        nearer = scratch.save(nearer, f"{tag}-jump{step}")
        moved = nearer.filter("moved").limit(1).count()
        parents = nearer.select("v", "p")
        if step:
            scratch.drop(f"{tag}-jump{step - 1}")
        if not moved:
            return parents
        step += 1


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root): every vertex of the edges (a, b) with the smallest vertex linked to it directly or not.

    Rows with a null side and loops do not link; a vertex that only has loops
    is left out.  Each round contracts the graph to its roots, so the number of
    vertices at least halves and a chain collapses in one round.
    """
    scratch = Scratch(edges.sparkSession, name)
    live = scratch.save(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    labels, k = None, 0
    while live.limit(1).count():
        hooks = both_ways(live).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        roots = jump(scratch, scratch.save(hooks, f"hooks-{k}"), f"round{k}")
        a, b = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        following = scratch.save(moved, f"edges-{k + 1}")
        if labels is None:
            labels = roots.select("v", F.col("p").alias("root"))
        else:
            up = roots.select(F.col("v").alias("root"), F.col("p").alias("upper"))
            labels = labels.join(up, "root", "left").select("v", F.coalesce("upper", "root").alias("root"))
        labels = scratch.save(labels, f"labels-{k}")
        scratch.drop(f"edges-{k}")
        scratch.drop(f"hooks-{k}")
        if k:
            scratch.drop(f"labels-{k - 1}")
        live, k = following, k + 1
    if labels is None:
        labels = live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
