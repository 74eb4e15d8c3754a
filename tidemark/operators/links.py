"""Linking rows: tracks, stereo pairs, sites, dates and positions.

Range conditions become equi-joins on buckets (``floor(x / width)`` and its
neighbours), so no plan needs a nested loop or a cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import haversine_km, iou
from tidemark.operators.graph import components
from tidemark.operators.ranks import percentile, placed
from tidemark.session import Scratch


def islands(rows: DataFrame, keys: list[str], order: str, gap: float, linked: Column | None = None) -> DataFrame:
    """rows with track: consecutive rows of a key whose gap is at most ``gap`` (and ``linked`` holds, if given).

    linked may use the previous row's columns under the prefix ``prev_``.
    """
    w = Window.partitionBy(*keys).orderBy(order, *[c for c in rows.columns if c not in (*keys, order)])
    prev = rows
    for c in rows.columns:
        if c not in keys:
            prev = prev.withColumn(f"prev_{c}", F.lag(c).over(w))
    joined = F.col(f"prev_{order}").isNotNull() & (F.col(order) - F.col(f"prev_{order}") <= gap)
    if linked is not None:
        joined &= linked
    marked = prev.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("track", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*rows.columns, "track")


def range_pairs(rows: DataFrame, keys: list[str], order: str, ident: str, width: int, carry: list[str]) -> DataFrame:
    """Pairs (a, b, delta, a_*, b_*) of rows of a key with 0 < b.order - a.order <= width.

    Every right row goes into the bucket before its own as well, so a pair meets
    in exactly one bucket.
    """
    bucket = F.floor(F.col(order) / F.lit(width))
    left = rows.select(*keys, F.col(ident).alias("a"), F.col(order).alias("_oa"), bucket.alias("_b"), *[F.col(c).alias(f"a_{c}") for c in carry])
    right = rows.select(*keys, F.col(ident).alias("b"), F.col(order).alias("_ob"), F.explode(F.array(bucket, bucket - 1)).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in carry])
    delta = F.col("_ob") - F.col("_oa")
    return left.join(right, [*keys, "_b"]).withColumn("delta", delta).filter((F.col("delta") > 0) & (F.col("delta") <= width)).drop("_b", "_oa", "_ob")


def range_tracks(rows: DataFrame, keys: list[str], order: str, ident: str, window: int, box: Sequence[str], threshold: float) -> DataFrame:
    """ident, track: rows linked within ``window`` where the boxes' overlap ratio reaches the threshold (0: any overlap).

    track is the smallest ident of the component; a row without a link is its own track.
    """
    pairs = range_pairs(rows, keys, order, ident, window, list(box))
    ratio = iou([F.col(f"a_{c}") for c in box], [F.col(f"b_{c}") for c in box])
    linked = pairs.filter(ratio >= threshold if threshold > 0 else ratio > 0).select("a", "b")
    found = components(linked, "tracks").select(F.col("v").alias(ident), F.col("root").alias("track"))
    return rows.select(ident).join(found, ident, "left").select(ident, F.coalesce("track", ident).alias("track"))


def track_summary(tracks: DataFrame, rho: float) -> DataFrame:
    """tracks, crops, mean_size, max_size, deff_mean, deff_kish, n_effective of (track, ...) rows.

    The design effect is 1 + (m - 1) rho with m the mean size or the size-weighted mean.
    """
    sizes = tracks.groupBy("track").agg(F.count("*").cast("double").alias("m"))
    s = sizes.agg(F.count("*").alias("tracks"), F.sum("m").alias("crops"), F.avg("m").alias("mean_size"), F.max("m").alias("max_size"), (F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("weighted"))
    kish = 1 + (F.col("weighted") - 1) * rho
    return s.select("tracks", F.col("crops").cast("long").alias("crops"), F.round("mean_size", 6).alias("mean_size"), F.col("max_size").cast("long").alias("max_size"), F.round(1 + (F.col("mean_size") - 1) * rho, 6).alias("deff_mean"), F.round(kish, 6).alias("deff_kish"), F.round(F.col("crops") / kish, 6).alias("n_effective"))


def shuffled_within(rows: DataFrame, keys: list[str], moved: list[str], ident: str, seed: int) -> DataFrame:
    """rows with the moved columns permuted inside each key (a null model)."""
    own = placed(rows, keys, [ident], "_i")
    other = placed(rows, keys, [F.sha2(F.concat_ws(":", F.lit(seed), F.col(ident).cast("string")), 256)], "_i").select(*keys, "_i", *moved)
    return own.drop(*moved).join(other, [*keys, "_i"]).select(*rows.columns)


def stereo_offset(rows: DataFrame, deployment: str, taxon: str, frame: str, camera: str, largest: int) -> DataFrame:
    """deployment, delta, votes: the commonest right minus left frame difference of a taxon, ties to the smallest."""
    per = rows.select(deployment, taxon, frame, camera).distinct()
    left = per.filter(F.col(camera) == "L").select(deployment, taxon, F.col(frame).alias("l"), F.floor(F.col(frame) / largest).alias("_b"))
    near = F.floor(F.col(frame) / largest)
    right = per.filter(F.col(camera) == "R").select(deployment, taxon, F.col(frame).alias("r"), F.explode(F.array(near - 1, near, near + 1)).alias("_b"))
    deltas = left.join(right, [deployment, taxon, "_b"]).select(deployment, (F.col("r") - F.col("l")).alias("delta")).filter(F.abs("delta") <= largest)
    votes = deltas.groupBy(deployment, "delta").agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(deployment).orderBy(F.desc("votes"), F.abs("delta"), "delta"))
    return votes.withColumn("rn", rank).filter("rn = 1").drop("rn")


def stereo_pairs(rows: DataFrame, offsets: DataFrame, deployment: str, taxon: str, frame: str, camera: str) -> DataFrame:
    """deployment, pairs, total: same-taxon sightings in frames that the offset aligns, the smaller camera count each."""
    counts = rows.groupBy(deployment, taxon, frame, camera).agg(F.count("*").alias("n"))
    left = counts.filter(F.col(camera) == "L").select(deployment, taxon, frame, F.col("n").alias("nl"))
    right = counts.filter(F.col(camera) == "R").join(offsets.select(deployment, "delta"), deployment).select(deployment, taxon, (F.col(frame) - F.col("delta")).alias(frame), F.col("n").alias("nr"))
    pairs = left.join(right, [deployment, taxon, frame]).groupBy(deployment).agg(F.sum(F.least("nl", "nr")).alias("pairs"))
    return rows.groupBy(deployment).agg(F.count("*").alias("total")).join(pairs, deployment, "left").select(deployment, F.coalesce("pairs", F.lit(0)).alias("pairs"), "total")


KM = 111.195  # of a degree on the sphere that distances are measured on


def cells(lat: Column, lon: Column, height: float) -> tuple[Column, Column]:
    """(row, column) of cells ``height`` degrees high and, at the row's edge nearer to the equator, as wide in kilometres."""
    row = F.floor(lat / height)
    return row, F.floor(lon / cell_width(row, height))


def cell_width(row: Column, height: float) -> Column:
    nearer = F.least(F.abs(row), F.abs(row + 1)) * height
    return F.least(F.lit(360.0), F.lit(height) / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), nearer))), F.lit(1e-6)))


def reach(row: Column, height: float, low: Column, high: Column, radius_km: float) -> Column:
    """Columns of a row that lie within radius_km of the longitudes low to high."""
    farther = F.greatest(F.abs(row), F.abs(row + 1)) * height
    room = F.lit(1.001 * radius_km / KM) / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), farther))), F.lit(1e-6))
    width = cell_width(row, height)
    return F.sequence(F.floor((low - F.least(room, F.lit(360.0))) / width), F.floor((high + F.least(room, F.lit(360.0))) / width))


def grid_sites(points: DataFrame, ident: str, lat: str, lon: str, radius_km: float) -> DataFrame:
    """ident, site: points within radius_km of each other, directly or through others; site is the smallest ident.

    All points of a cell are one site, since its diagonal is under the radius.
    Neighbouring cells are first compared by the points that lie outermost in
    eight directions; only where these do not link two cells, and nothing else
    does, are their points compared, so a dense site costs its cells, not its
    pairs.  Points without a position are sites of their own.  Links across the
    date line are not made.
    """
    scratch = Scratch(points.sparkSession, "sites")
    height = radius_km / KM / 1.5
    valid = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")))
    row, column = cells(F.col(lat), F.col(lon), height)
    p = scratch.save(valid.select(F.col(ident).alias("i"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"), row.alias("r"), column.alias("c")), "points")
    at = F.struct("la", "lo")
    outer = [f(at, F.col("la") * a + F.col("lo") * b) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1)) for f in (F.min_by, F.max_by)]
    held = scratch.save(p.groupBy("r", "c").agg(F.min("i").alias("cell"), F.array(*outer).alias("outer"), F.min("lo").alias("west"), F.max("lo").alias("east")), "cells")
    near_rows = held.select("cell", "outer", "west", "east", F.explode(F.array(*[F.col("r") + d for d in range(-2, 3)])).alias("r"))
    asked = near_rows.select(F.col("cell").alias("a"), F.col("outer").alias("outer_a"), "r", F.explode(reach(F.col("r"), height, F.col("west"), F.col("east"), radius_km)).alias("c"))
    pairs = asked.join(held.select(F.col("cell").alias("b"), F.col("outer").alias("outer_b"), "r", "c"), ["r", "c"]).filter("a < b")
    close = F.exists("outer_a", lambda x: F.exists("outer_b", lambda y: haversine_km(x["la"], x["lo"], y["la"], y["lo"]) <= radius_km))
    pairs = scratch.save(pairs.select("a", "b", close.alias("close")).distinct(), "pairs")
    sure = pairs.filter("close").select("a", "b")
    found = components(sure, "sites")
    first, second = found.select(F.col("v").alias("a"), F.col("root").alias("ra")), found.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    open_ = pairs.filter("not close").join(first, "a", "left").join(second, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    own = p.join(held.select("r", "c", "cell"), ["r", "c"]).select("cell", "la", "lo")
    one, other = own.select(F.col("cell").alias("a"), F.col("la").alias("la1"), F.col("lo").alias("lo1")), own.select(F.col("cell").alias("b"), F.col("la").alias("la2"), F.col("lo").alias("lo2"))
    met = open_.join(one, "a").join(other, "b").filter(haversine_km(F.col("la1"), F.col("lo1"), F.col("la2"), F.col("lo2")) <= radius_km).select("a", "b").distinct()
    met = scratch.save(met, "met")
    # links between sites found already: these are few, and so are their roots
    upper = components(met.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "sites-all") if met.limit(1).count() else None
    sites = found.select(F.col("v").alias("cell"), F.col("root").alias("site"))
    if upper is not None:
        of_cells = held.select("cell").join(sites, "cell", "left").select("cell", F.coalesce("site", "cell").alias("v"))
        sites = of_cells.join(upper, "v", "left").select("cell", F.coalesce("root", "v").alias("site"))
    of = p.join(held.select("r", "c", "cell"), ["r", "c"]).join(sites, "cell", "left").select("i", F.coalesce("site", "cell").alias("site"))
    return points.select(F.col(ident).alias("i")).join(of.distinct(), "i", "left").select(F.col("i").alias(ident), F.coalesce("site", "i").alias("site"))


def spread(points: DataFrame, group: str, lat: str, lon: str) -> DataFrame:
    """group, n, centre_lat, centre_lon, p95_km: distances from the median position (upper median, value at int(0.95 n))."""
    sizes = points.groupBy(group).agg(F.count("*").alias("n"))
    centre = sizes.join(percentile(points, [group], lat, 0.5, "centre_lat"), group).join(percentile(points, [group], lon, 0.5, "centre_lon"), group)
    far = points.join(centre, group).select(group, haversine_km(F.col(lat), F.col(lon), F.col("centre_lat"), F.col("centre_lon")).alias("km"))
    return centre.join(percentile(far, [group], "km", 0.95, "p95_km"), group).select(group, "n", "centre_lat", "centre_lon", F.round("p95_km", 4).alias("p95_km"))


def out_of_order(rows: DataFrame, key: str, order: str, value: str, slack: float) -> DataFrame:
    """key, order, value, behind: rows whose value lies more than slack behind the largest earlier one of the key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.max(value).over(w) - F.col(value)
    return rows.select(key, order, value, behind.alias("behind")).filter(F.col("behind") > slack)


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, carry: list[str]) -> DataFrame:
    """left with carry columns of the latest right row of the key at or before ``at`` (as-of join by one sorted pass)."""
    names = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.lit(1).alias("_side"), *names, *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in carry])
    b = right.select(*keys, at, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], *[F.col(c).alias(f"_{c}") for c in carry])
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    packed = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{c}").alias(c) for c in carry])), ignorenulls=True).over(w)
    return both.withColumn("_m", packed).filter("_side = 1").select(*keys, at, *names, *[F.col(f"_m.{c}").alias(c) for c in carry])
