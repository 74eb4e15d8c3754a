"""Profiles of a collection: counts, sizes, shares, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import iou, valid_position
from tidemark.functions.text import hash_order
from tidemark.operators.ranks import placed


def rollup_counts(rows: DataFrame, levels: Sequence[str], text: str, place: str) -> DataFrame:
    """levels, docs, texts, empties, placed_pct, level: counts of every prefix of the levels; level is the number of those summed over."""
    summed = sum((F.grouping(c) for c in levels[1:]), F.grouping(levels[0]))
    empty = F.col(text).isNull() | (F.col(text) == "")
    return rows.rollup(*levels).agg(F.count("*").alias("docs"), F.count_distinct(text).alias("texts"), F.count_if(empty).alias("empties"), F.round(100.0 * F.count(place) / F.count("*"), 4).alias("placed_pct"), summed.cast("long").alias("level"))


def cube_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, gid: counts of every combination of the keys."""
    return rows.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("gid"))


def histogram_map(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """key, value, label, n: how often each label of each value column occurs, nulls as ``none``; one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(v).alias("value"), F.coalesce(F.col(v).cast("string"), F.lit("none")).alias("label")) for v in values])
    return rows.select(key, F.inline(pairs)).groupBy(key, "value", "label").agg(F.count("*").alias("n"))


def category_profile(rows: DataFrame, category: str, source: str, group: str, size: Column) -> DataFrame:
    """category, sources, crops, groups, smallest: where each category is seen, the sources joined by a bar."""
    return rows.groupBy(category).agg(F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.count("*").alias("crops"), F.count_distinct(group).alias("groups"), F.min(size).alias("smallest"))  # at most one element per source


def size_summary(sizes: DataFrame, keys: Sequence[str], value: str, bars: Sequence[int] = (64, 32)) -> DataFrame:
    """keys, n, p10, median, p90 (lower of the usual definitions) and the percentage under each bar."""
    pct = [F.expr(f"percentile_disc({q}) within group (order by `{value}`)").cast("double").alias(x) for x, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))]
    return sizes.groupBy(*keys).agg(F.count("*").alias("n"), *pct, *[F.round(100.0 * F.count_if(F.col(value) < t) / F.count("*"), 4).alias(f"under_{t}_pct") for t in bars])


def cap_cost(sizes: DataFrame, longer: Column, shorter: Column, caps: Sequence[int], least: int) -> DataFrame:
    """cap, touched, short_after, worst: what scaling down to each longest side costs."""
    c = sizes.select(longer.alias("lo"), shorter.alias("sh"), F.explode(F.array(*[F.lit(x) for x in caps])).alias("cap"))
    over, after = F.col("lo") > F.col("cap"), F.col("sh") * (F.col("cap").cast("double") / F.col("lo"))
    return c.groupBy("cap").agg(F.count_if(over).alias("touched"), F.count_if(over & (after < least)).alias("short_after"), F.round(F.min(F.when(over, after)), 6).alias("worst"))


def log_histogram(rows: DataFrame, value: str, per_octave: int = 8) -> DataFrame:
    """bin, n: counts of floor(log2(value) * per_octave); values that are not above 0 are left out."""
    return rows.filter(F.col(value) > 0).groupBy(F.floor(F.log2(value) * per_octave).alias("bin")).agg(F.count("*").alias("n"))


def edge_histogram(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """bin, low, high, n of right-open bins between the edges, the empty ones too; bin 0 begins at the first edge.

    Values below the first or from the last edge on, nulls and NaN have no bin.
    """
    v = F.col(value).cast("double")
    at = F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(-1), lambda a, e: a + (e <= v).cast("int"))
    counts = rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    bins = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def share_drift(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """group, drift, sigma: how far a group's share of hits lies from that of all, and in standard errors of the smaller of both."""
    c = rows.select(group, hit.cast("double").alias("u"))
    whole = c.agg(F.avg("u").alias("p0"), F.count("*").cast("double").alias("n0"))
    own = c.groupBy(group).agg(F.avg("u").alias("p"), F.count("*").cast("double").alias("n")).join(F.broadcast(whole))  # one row
    d = F.col("p") - F.col("p0")
    return own.select(group, F.round(d, 6).alias("drift"), F.round(F.try_divide(d, F.sqrt(F.col("p0") * (1 - F.col("p0")) / F.least("n", "n0"))), 4).alias("sigma"))


def mixture_shares(rows: DataFrame, group: str, frame: str, hit: Column) -> DataFrame:
    """by_boxes, by_frames: the share of hits when groups weigh by their boxes, and by their frames."""
    b = rows.groupBy(group).agg(F.count("*").alias("boxes"), F.count_distinct(frame).alias("frames"), F.avg(hit.cast("double")).alias("under"))
    return b.agg(*[F.round(F.sum(F.col(x) * F.col("under")) / F.sum(x), 6).alias(f"by_{x}") for x in ("boxes", "frames")])


def geo_bins(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """la, lo, n: valid positions by whole degrees."""
    return points.filter(valid_position(F.col(lat), F.col(lon))).groupBy(F.floor(lat).alias("la"), F.floor(lon).alias("lo")).agg(F.count("*").alias("n"))


def name_usage(categories: DataFrame, ident: str, lineage: Column, weight: str | None = None) -> DataFrame:
    """lvl, nm, cats, crops: by how many categories, and crops of these, each name of a lineage (map of level to name) is used."""
    e = categories.select(ident, F.coalesce(F.col(weight), F.lit(0)).alias("_w") if weight else F.lit(0).alias("_w"), F.explode(lineage).alias("lvl", "nm")).filter("nm is not null")
    return e.groupBy("lvl", "nm").agg(F.count_distinct(ident).alias("cats"), F.sum("_w").alias("crops"))


def audit_rates(verdicts: DataFrame, keys: Sequence[str], verdict: str) -> DataFrame:
    """keys, n, floor_pct, ceiling_pct, sure_pct: wrong of all, wrong or unsure of all, wrong of the sure ones; by source, size bin or taxon."""
    v = F.col(verdict)
    wrong, sure = F.count_if(v == "wrong"), F.count_if(v != "unsure")
    return verdicts.groupBy(*keys).agg(F.count("*").alias("n"), F.round(100.0 * wrong / F.count("*"), 4).alias("floor_pct"), F.round(100.0 * F.count_if(v != "right") / F.count("*"), 4).alias("ceiling_pct"), F.round(100.0 * wrong / F.nullif(sure, F.lit(0)), 4).alias("sure_pct"))


def composition(rows: DataFrame, group: str, part: str, parts: Sequence[object], prefix: str) -> DataFrame:
    """group and one count column per part (``prefix`` and the part), 0 where there is none."""
    return rows.groupBy(group).agg(*[F.count(F.when(F.col(part) == p, 1)).alias(f"{prefix}{p}") for p in parts])


def neighbour_overlap(rows: DataFrame, keys: Sequence[str], order: str, ident: str, box: Sequence[str]) -> DataFrame:
    """n, mean_ratio: boxes of directly following frames of a key and their mean overlap ratio, without a threshold."""
    w = Window.partitionBy(*keys).orderBy(order, ident)
    s = rows.select(order, *box, *[F.lead(c).over(w).alias(f"n_{c}") for c in (order, *box)]).filter(F.col(f"n_{order}") - F.col(order) == 1)
    return s.agg(F.count("*").alias("n"), F.round(F.avg(iou([F.col(c) for c in box], [F.col(f"n_{c}") for c in box])), 6).alias("mean_ratio"))


def sheet_pages(rows: DataFrame, group: str, key: str, page: int, seed: object) -> DataFrame:
    """key, group, sheet (from 1), place (from 0): records of a group in hash order on pages of ``page``."""
    i = F.col("_i") - 1
    return placed(rows.select(key, group), [group], [hash_order(F.lit(seed), F.col(key)), key], "_i").select(key, group, (F.floor(i / page) + 1).cast("int").alias("sheet"), (i % page).cast("int").alias("place"))


def split_of(rows: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with in_dev: whether a table of deployments lists theirs; a null key is not listed."""
    return rows.join(listed.select(*on, F.lit(True).alias("_d")).distinct(), list(on), "left").withColumn("in_dev", F.coalesce("_d", F.lit(False))).drop("_d")


def gate_losses(before: DataFrame, after: DataFrame, taxon: str, group: str, unit: str, crops: Sequence[int], groups: Sequence[int]) -> DataFrame:
    """min_crops, min_groups, passed, passed_units, lost, inflation of taxa before and after rows are taken away.

    passed counts crops, passed_units distinct units; inflation is by how much
    the first exceeds the second; lost are those that passed before and do not
    now.  With min_groups 0 only crops count, also of rows without a group.
    """
    def bars(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy(taxon).agg(F.count("*").alias("n"), F.count_distinct(unit).alias("u"), F.count_distinct(group).alias("g"))
        cells = F.array(*[F.struct(F.lit(c).alias("min_crops"), F.lit(g).alias("min_groups")) for c in crops for g in groups])
        wide = F.col("g") >= F.col("min_groups")
        return per.select(taxon, "n", "u", "g", F.inline(cells)).select(taxon, "min_crops", "min_groups", ((F.col("n") >= F.col("min_crops")) & wide).alias(f"{name}_crops"), ((F.col("u") >= F.col("min_crops")) & wide).alias(f"{name}_units"))

    both = bars(before, "before").join(bars(after, "after"), [taxon, "min_crops", "min_groups"], "left")
    at = F.coalesce("after_crops", F.lit(False))
    out = both.groupBy("min_crops", "min_groups").agg(F.count_if("before_crops").alias("passed"), F.count_if("before_units").alias("passed_units"), F.count_if(F.col("before_crops") & ~at).alias("lost"))
    return out.withColumn("inflation", F.round(F.try_divide(F.col("passed"), F.col("passed_units")), 6))


def testable_table(drawn: DataFrame, taxon: str, group: str, key: str, details: DataFrame, source: str) -> DataFrame:
    """taxon, sources, n_crops, n_groups of the records that a draw (taxon, group, key) uses; details gives each key's source."""
    own = drawn.select(taxon, group, key).distinct().join(details.select(key, source).distinct(), key)
    return own.groupBy(taxon).agg(F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.count_distinct(key).alias("n_crops"), F.count_distinct(source, group).alias("n_groups"))  # at most one element per source


def shared_examples(rows: DataFrame, taxon: str, source: str, key: str, first: object, second: object, taxa: int, each: int = 3) -> DataFrame:
    """place, taxon, source, key: the taxa with ``each`` records in both sources and most in the scarcer one, with evenly strided records.

    The number of taxa is the feature (a figure's rows); ties go to the smaller taxon.
    """
    own = rows.filter(F.col(source).isin(first, second) & F.col(taxon).isNotNull())
    per = own.groupBy(taxon).agg(F.count(F.when(F.col(source) == first, 1)).alias("_a"), F.count(F.when(F.col(source) == second, 1)).alias("_b"))
    best = per.withColumn("_least", F.least("_a", "_b")).filter(F.col("_least") >= each).orderBy(F.desc("_least"), taxon).limit(taxa)
    order = placed(best.select(taxon, "_least"), [], [-F.col("_least"), F.col(taxon)], "place")
    named = own.join(F.broadcast(order.select(taxon, "place")), taxon)  # ``taxa`` rows
    at = placed(named.select("place", taxon, source, key), [taxon, source], [key], "_rn")
    size = named.groupBy(taxon, source).agg(F.floor(F.count("*") / each).alias("_step"))
    strided = at.join(F.broadcast(size), [taxon, source]).filter((F.pmod(F.col("_rn") - 1, F.col("_step")) == 0) & (F.col("_rn") <= F.col("_step") * each))
    return strided.select("place", taxon, source, key)


def concept_counts(rows: DataFrame, concept: str, institution: str, record: str) -> DataFrame:
    """concept, institution, boxes, records, by concept and institution and in all (null institution summed over)."""
    return rows.withColumn("_i", F.coalesce(F.col(institution), F.lit("unknown"))).rollup(concept, "_i").agg(F.count("*").alias("boxes"), F.count_distinct(record).alias("records"), F.grouping(concept).alias("_g")).filter("_g = 0").select(concept, F.col("_i").alias("institution"), "boxes", "records")
