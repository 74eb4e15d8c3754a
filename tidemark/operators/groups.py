"""Choosing and naming groups, representatives and backgrounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import haversine_km, touches
from tidemark.functions.text import hash_order
from tidemark.operators.links import KM, cells, reach


def box_kinds(rows: DataFrame, file: str, empty: Column, width: str, height: str) -> DataFrame:
    """file, kept, unlabelled, boxes: an image stays if it has a valid box or is marked empty; a degenerate box marks unlabelled animals."""
    valid = F.coalesce((F.col(width) > 0) & (F.col(height) > 0), F.lit(False))
    blank = F.coalesce(empty, F.lit(False))
    per = rows.groupBy(file).agg(F.count_if(~blank & valid).alias("boxes"), F.bool_or(blank).alias("blank"), F.bool_or(~blank & ~valid).alias("unlabelled"))
    return per.select(file, ((F.col("boxes") > 0) | F.col("blank")).alias("kept"), "unlabelled", "boxes")


def representatives(rows: DataFrame, group: str, taxon: str, camera: str, key: str, unit: Column) -> DataFrame:
    """rows of the camera that saw more of a taxon in a group (left if tied), the first key of each unit; a null unit stands for itself."""
    cams = rows.groupBy(group, taxon).agg(F.when(F.count_if(F.col(camera) == "L") >= F.count_if(F.col(camera) == "R"), "L").otherwise("R").alias("_cam"))
    best = rows.join(cams, [group, taxon]).filter(F.col(camera).isNull() | (F.col(camera) == F.col("_cam"))).drop("_cam")
    marked = best.withColumn("_unit", F.coalesce(unit.cast("string"), F.concat(F.lit("key "), F.col(key))))
    return marked.withColumn("_rn", F.row_number().over(Window.partitionBy(group, taxon, "_unit").orderBy(key))).filter("_rn = 1").drop("_unit", "_rn")


def group_level(members: DataFrame, group: str, level: str, reliable: str, order: Sequence[str]) -> DataFrame:
    """group, level: the coarsest level of its reliable members, or of all where none is reliable; order goes from fine to coarse."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(level))
    per = members.groupBy(group).agg(F.max(F.when(F.col(reliable), place)).alias("r"), F.max(place).alias("a"))
    return per.select(group, F.element_at(F.array(*[F.lit(x) for x in order]), F.coalesce("r", "a").cast("int")).alias(level))


def safe_groups(rows: DataFrame, group: str, rule: str, unsafe: Sequence[str]) -> DataFrame:
    """group, safe: named groups of which at least one rule is not among the unsafe ones."""
    named = rows.filter(F.coalesce(group, F.lit("")) != "")
    return named.groupBy(group).agg((F.size(F.array_except(F.collect_set(rule), F.array(*[F.lit(x) for x in unsafe]))) > 0).alias("safe"))  # as many elements as rules


def date_links(rows: DataFrame, space: str, day: str, token: str, reliable: str) -> DataFrame:
    """a, b: links that join the tokens of a namespace and day into one component, where it has unreliable and reliable ones.

    Each token is linked to the day's smallest reliable one (a, apart from it),
    so a day costs its tokens, not their pairs.
    """
    tokens = rows.filter(F.col(day).isNotNull() & F.col(token).isNotNull() & F.col(reliable).isNotNull()).groupBy(space, day, token).agg(F.bool_or(reliable).alias("_r"), F.bool_and(reliable).alias("_all"))
    days = tokens.groupBy(space, day).agg(F.min(F.when(F.col("_r"), F.col(token))).alias("b"), F.bool_and("_all").alias("_sure")).filter(F.col("b").isNotNull() & ~F.col("_sure"))
    return tokens.join(days, [space, day]).select(F.col(token).alias("a"), "b").filter("a <> b").distinct()


def position_links(points: DataFrame, centres: DataFrame, space: str, ident: str, token: str, radius_km: float) -> DataFrame:
    """ident, token: points within radius_km of a centre of the same namespace.

    A point looks into its own cell; the centres stand in every cell that the
    radius reaches.  Links across the date line are not made.
    """
    height = radius_km / KM
    row, column = cells(F.col("lat"), F.col("lon"), height)
    p = points.select(space, ident, F.col("lat").alias("la"), F.col("lon").alias("lo"), row.alias("_r"), column.alias("_c"))
    c = centres.filter("lat is not null and lon is not null").select(space, token, "lat", "lon", F.explode(F.array(row - 1, row, row + 1)).alias("_r"))
    c = c.select("*", F.explode(reach(F.col("_r"), height, F.col("lon"), F.col("lon"), radius_km)).alias("_c"))
    return p.join(c, [space, "_r", "_c"]).filter(haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")) <= radius_km).select(ident, token)


def fallback_lookup(rows: DataFrame, frames: DataFrame, name: str, loose: Sequence[str], value: str) -> DataFrame:
    """rows with value and route: by exact name, else by the loose key (first name wins), else none."""
    exact = frames.select(name, F.col(value).alias("_exact")).dropDuplicates([name])
    first = frames.withColumn("_rn", F.row_number().over(Window.partitionBy(*loose).orderBy(name))).filter("_rn = 1").select(*loose, F.col(value).alias("_loose"))
    both = rows.join(exact, name, "left").join(first, list(loose), "left")
    route = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").otherwise("none")
    return both.withColumn(value, F.coalesce("_exact", "_loose")).withColumn("route", route).drop("_exact", "_loose")


def place_backgrounds(frames: DataFrame, boxes: DataFrame, frame: str, sizes: Sequence[tuple[int, int]], margin: float, tries: int, seed: str) -> DataFrame:
    """frame, w, h, x, y: the first of ``tries`` places of one drawn size that clears every box of the frame.

    The size and the places come from hashes of seed, frame and try.  Frames
    have width and height; those without a clear place are left out.
    """

    def uniform(*parts: Column) -> Column:
        return F.conv(F.substring(hash_order(F.lit(seed), *parts), 1, 8), 16, 10).cast("double") / 4294967296.0

    pool = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in sizes])
    drawn = frames.withColumn("_s", F.element_at(pool, (F.floor(uniform(F.lit("size"), F.col(frame)) * len(sizes)) + 1).cast("int")))
    fits = drawn.select(frame, "width", "height", F.col("_s.w").alias("w"), F.col("_s.h").alias("h")).filter("w <= width and h <= height")
    held = boxes.groupBy(frame).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_boxes"))  # boxes of one frame
    placed = fits.join(held, frame, "left").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    placed = placed.withColumn("x", F.floor(uniform(F.lit("x"), F.col("t"), F.col(frame)) * (F.col("width") - F.col("w") + 1)).cast("int")).withColumn("y", F.floor(uniform(F.lit("y"), F.col("t"), F.col(frame)) * (F.col("height") - F.col("h") + 1)).cast("int"))
    own = [F.col(c) for c in ("x", "y", "w", "h")]
    hit = F.coalesce(F.exists("_boxes", lambda b: touches(own, [b[c] for c in ("x", "y", "w", "h")], margin)), F.lit(False))
    clear = placed.filter(~hit)
    return clear.groupBy(frame).agg(F.min(F.struct("t", "w", "h", "x", "y")).alias("p")).select(frame, "p.w", "p.h", "p.x", "p.y")


def testable_k(rows: DataFrame, taxon: str, group: str, ks: Sequence[int], q: int, groups: int) -> DataFrame:
    """taxon, k: the largest k of ks with k + q rows, q of them outside the largest group, in at least that many groups."""
    per = rows.groupBy(taxon, group).agg(F.count("*").alias("n")).groupBy(taxon).agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count(F.nullif(F.col(group).cast("string"), F.lit(""))).alias("g"))
    ok = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (F.col("total") >= k + q) & (F.col("total") - F.col("largest") >= q) & (F.col("g") >= groups))
    return per.select(taxon, F.array_max(ok).alias("k")).filter("k is not null")


def first_passing_seed(rows: DataFrame, stratum: str, group: str, fraction: float, seeds: int, least: int) -> DataFrame:
    """seed, stratum, group: the draw of rint(fraction * groups) per stratum of the first seed whose rows reach ``least`` in every stratum."""
    per = rows.groupBy(stratum, group).agg(F.count("*").alias("n")).withColumn("size", F.count("*").over(Window.partitionBy(stratum)))
    each = per.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    rn = F.row_number().over(Window.partitionBy("seed", stratum).orderBy(hash_order(F.col("seed"), F.col(group)), group))
    drawn = each.withColumn("rn", rn).filter(F.col("rn") <= F.rint(F.col("size") * fraction))
    strata = rows.select(stratum).distinct().agg(F.count("*").alias("strata"))
    passed = drawn.groupBy("seed", stratum).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).groupBy("seed").agg(F.count("*").alias("ok")).join(F.broadcast(strata)).filter("ok = strata").agg(F.min("seed").alias("seed"))
    return drawn.join(F.broadcast(passed), "seed").select("seed", stratum, group)


def cascade(rows: DataFrame, steps: Sequence[tuple[Column, DataFrame]], name: str, value: str) -> DataFrame:
    """rows with value and step: the first lookup (name, value) that knows the row's key for that step."""
    out = rows.withColumn("_i", F.monotonically_increasing_id())
    found: list[Column] = []
    for i, (key, lookup) in enumerate(steps):
        out = out.withColumn("_k", key).join(lookup.groupBy(F.col(name).alias("_k")).agg(F.min(value).alias(f"_v{i}")), "_k", "left").drop("_k")
        found.append(F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("v"), F.lit(i).alias("s"))))
    got = F.coalesce(*found)
    return out.withColumn(value, got["v"]).withColumn("step", got["s"]).drop("_i", *[f"_v{i}" for i in range(len(steps))])


def transfer_scores(cells: DataFrame, keys: Sequence[str], cross: str, baseline: str, candidates: str, least: int) -> DataFrame:
    """keys, candidates, cross, baseline, difference, ratio, chance; empty where there are fewer candidates than ``least``."""
    enough = F.col(candidates) >= least
    c, b = F.col(cross), F.col(baseline)
    return cells.select(*keys, candidates, *[F.when(enough, x).alias(n) for n, x in (("cross", F.round(c, 6)), ("baseline", F.round(b, 6)), ("difference", F.round(c - b, 6)), ("ratio", F.round(F.try_divide(c, F.when(b > 0, b)), 6)), ("chance", F.round(1.0 / F.col(candidates), 6)))])


def relative_difference(a: Column, b: Column) -> Column:
    """Largest absolute difference of two arrays over the largest absolute value of the first."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.when(top > 0, top)


def offset_search(wanted: DataFrame, held: DataFrame, keys: Sequence[str], frame: str, camera: str, ident: str, window: int) -> DataFrame:
    """ident, delta, camera: the nearest held frame within the window, ties to the smaller offset, then to the left camera.

    Each wanted frame looks up its 2 * window + 1 frames by an equi-join.
    """
    tried = wanted.withColumn("delta", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("_f", F.col(frame) + F.col("delta"))
    hits = tried.select(*keys, ident, "delta", F.col("_f").alias(frame)).join(held.select(*keys, frame, camera).distinct(), [*keys, frame])
    best = F.row_number().over(Window.partitionBy(ident).orderBy(F.abs("delta"), "delta", camera))
    return hits.withColumn("_rn", best).filter("_rn = 1").select(ident, "delta", camera)


def only_in_block(rows: DataFrame, block: str, concept: str) -> DataFrame:
    """block, concept, n: concepts of which every row lies in one block."""
    per = rows.groupBy(concept, block).agg(F.count("*").alias("n"))
    return per.groupBy(concept).agg(F.min(block).alias(block), F.count("*").alias("_b"), F.sum("n").alias("n")).filter("_b = 1").select(block, concept, "n")


def volume_estimate(rows: DataFrame, by: str, image: str, size: str) -> DataFrame:
    """by, images, boxes_per_image, bytes: boxes over the mean boxes of an image, times the median size."""
    per = rows.groupBy(by, image).agg(F.count("*").alias("b"), F.max(size).alias("s"))
    g = per.groupBy(by).agg(F.count("*").alias("images"), F.avg("b").alias("m"), F.sum("b").alias("boxes"), F.percentile("s", F.lit(0.5)).alias("median"))
    return g.select(by, "images", F.round("m", 6).alias("boxes_per_image"), F.round(F.col("boxes") / F.col("m") * F.col("median"), 4).alias("bytes"))


def random_baseline(counts: DataFrame, group: str, taxon: str, units: str, need: int, sizes: Sequence[int], seeds: int) -> DataFrame:
    """seed, size, covered: taxa that reach ``need`` units in the first groups of a hash order, per seed and number of groups."""
    order = counts.select(group).distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    ranked = order.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy(hash_order(F.col("seed"), F.col(group)), group)))
    picked = ranked.filter(F.col("rn") <= max(sizes)).withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("rn"))))
    held = picked.join(counts, group).groupBy("seed", "size", taxon).agg(F.sum(units).alias("u"))
    return held.groupBy("seed", "size").agg(F.count_if(F.col("u") >= need).alias("covered"))


def counts_with_empties(images: DataFrame, boxes: DataFrame, image: str, by: str) -> DataFrame:
    """by, images, boxes, empties: images without a box count as empties."""
    per = boxes.groupBy(image).agg(F.count("*").alias("b"))
    return images.select(image, by).distinct().join(per, image, "left").groupBy(by).agg(F.count("*").alias("images"), F.sum(F.coalesce("b", F.lit(0))).alias("boxes"), F.count_if(F.col("b").isNull()).alias("empties"))
