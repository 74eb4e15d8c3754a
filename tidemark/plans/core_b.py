"""Queries: links, samples, vectors, decisions, shards, chains and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import stats
from tidemark.operators import decisions, graph, links, profile, resolve, sampling, shards, vectors
from tidemark.plans.registry import query
from tidemark.plans.rehosted import CROPS_SQL, RESULTS_SQL, SIGHTINGS_SQL, VECTORS_SQL, crops, results, sightings
from tidemark.plans.rehosted import vectors as embedded
from tidemark.session import Scratch, table
from tidemark.streaming import sessions

WITH = f"WITH crops AS ({CROPS_SQL})"
SEEN = f"WITH RECURSIVE s AS ({SIGHTINGS_SQL})"
VEC = f"WITH v AS ({VECTORS_SQL})"
BOX = ("x", "y", "w", "h")
IOU_SQL = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0))::DOUBLE"
RATIO_SQL = f"{IOU_SQL} / (a.w * a.h + b.w * b.h - {IOU_SQL})"


@query("islands_tracks", f"""{SEEN}, p AS (SELECT *, lag(frame) OVER w pf FROM s WINDOW w AS (PARTITION BY video, taxon ORDER BY frame, ident)), t AS (SELECT video, taxon, frame, ident, sum(CASE WHEN frame - pf <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY video, taxon ORDER BY frame, ident) track FROM p)
SELECT video, taxon, track::BIGINT track, count(*) n, min(frame) first, max(frame) AS "last" FROM t GROUP BY ALL""")
def islands_tracks(spark: SparkSession, sf: str) -> DataFrame:
    t = links.islands(sightings(spark, sf).select("video", "taxon", "frame", "ident"), ["video", "taxon"], "frame", 5)
    return t.groupBy("video", "taxon", "track").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@query("islands_overlap", f"""{SEEN}, p AS (SELECT *, lag(frame) OVER k pf, lag(x) OVER k px, lag(y) OVER k py, lag(w) OVER k pw, lag(h) OVER k ph FROM s WINDOW k AS (PARTITION BY video, taxon ORDER BY frame, ident)),
q AS (SELECT *, (greatest(least(x + w, px + pw) - greatest(x, px), 0) * greatest(least(y + h, py + ph) - greatest(y, py), 0))::DOUBLE i FROM p), t AS (SELECT video, taxon, sum(CASE WHEN frame - pf <= 30 AND i / (w * h + pw * ph - i) > 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY video, taxon ORDER BY frame, ident) track FROM q)
SELECT video, taxon, track::BIGINT track, count(*) n FROM t GROUP BY ALL""")
def islands_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = sightings(spark, sf).select("video", "taxon", "frame", "ident", *BOX)
    linked = G.iou([F.col(c) for c in BOX], [F.col(f"prev_{c}") for c in BOX]) > 0.2
    return links.islands(s, ["video", "taxon"], "frame", 30, linked).groupBy("video", "taxon", "track").agg(F.count("*").alias("n"))


@query("range_pairs", f"""{SEEN} SELECT a.ident a, b.ident b, b.frame - a.frame delta, round({RATIO_SQL}, 6) ratio FROM s a JOIN s b ON a.video = b.video AND a.taxon = b.taxon AND b.frame - a.frame BETWEEN 1 AND 12""")
def range_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = links.range_pairs(sightings(spark, sf), ["video", "taxon"], "frame", "ident", 12, list(BOX))
    return p.select("a", "b", "delta", F.round(G.iou([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX]), 6).alias("ratio"))


@query("range_tracks", f"""{SEEN}, e AS (SELECT a.ident a, b.ident b FROM s a JOIN s b ON a.video = b.video AND a.taxon = b.taxon AND b.frame - a.frame BETWEEN 1 AND 12 AND {RATIO_SQL} >= 0.3),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT ident v, ident root FROM s UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.v) SELECT v ident, min(root) track FROM r GROUP BY v""")
def range_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return links.range_tracks(sightings(spark, sf), ["video", "taxon"], "frame", "ident", 12, BOX, 0.3)


@query("track_deff", f"""{SEEN}, p AS (SELECT *, lag(frame) OVER w pf FROM s WINDOW w AS (PARTITION BY video, taxon ORDER BY frame, ident)), t AS (SELECT video, taxon, sum(CASE WHEN frame - pf <= 24 THEN 0 ELSE 1 END) OVER (PARTITION BY video, taxon ORDER BY frame, ident) track FROM p),
m AS (SELECT count(*)::DOUBLE m FROM t GROUP BY video, taxon, track), g AS (SELECT count(*) tracks, sum(m) crops, avg(m) mean, max(m) top, sum(m * m) / sum(m) wm FROM m)
SELECT tracks, crops::BIGINT crops, round(mean, 6) mean_size, top::BIGINT max_size, round(1 + (mean - 1) * 0.5::DOUBLE, 6) deff_mean, round(1 + (wm - 1) * 0.5::DOUBLE, 6) deff_kish, round(crops / (1 + (wm - 1) * 0.5::DOUBLE), 6) n_effective FROM g""")
def track_deff(spark: SparkSession, sf: str) -> DataFrame:
    t = links.islands(sightings(spark, sf).select("video", "taxon", "frame", "ident"), ["video", "taxon"], "frame", 24)
    return links.track_summary(t.select(F.struct("video", "taxon", "track").alias("track")), 0.5)


@query("gap_one_overlap", f"""{SEEN}, p AS (SELECT x, y, w, h, frame, lead(x) OVER k nx, lead(y) OVER k ny, lead(w) OVER k nw, lead(h) OVER k nh, lead(frame) OVER k nf FROM s WINDOW k AS (PARTITION BY video, taxon ORDER BY frame, ident)),
q AS (SELECT (greatest(least(x + w, nx + nw) - greatest(x, nx), 0) * greatest(least(y + h, ny + nh) - greatest(y, ny), 0))::DOUBLE i, w * h + nw * nh u FROM p WHERE nf - frame = 1) SELECT count(*) n, round(avg(i / (u - i)), 6) mean_ratio FROM q""")
def gap_one_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return profile.neighbour_overlap(sightings(spark, sf), ["video", "taxon"], "frame", "ident", BOX)


@query("null_shuffle", f"""{SEEN}, a AS (SELECT ident, video, frame, row_number() OVER (PARTITION BY video ORDER BY ident) i FROM s), b AS (SELECT video, x, y, row_number() OVER (PARTITION BY video ORDER BY sha256('5:' || ident)) i FROM s) SELECT ident, a.video, frame, x, y FROM a JOIN b ON a.video = b.video AND a.i = b.i""")
def null_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return links.shuffled_within(sightings(spark, sf).select("ident", "video", "frame", "x", "y"), ["video"], ["x", "y"], "ident", 5)


STEREO_SQL = f"""{SEEN}, u AS (SELECT DISTINCT video, taxon, frame, camera FROM s), d AS (SELECT l.video, r.frame - l.frame delta, count(*) votes FROM u l JOIN u r ON l.video = r.video AND l.taxon = r.taxon AND l.camera = 'L' AND r.camera = 'R' AND abs(r.frame - l.frame) <= 48 GROUP BY ALL),
o AS (SELECT video, delta, votes FROM d QUALIFY row_number() OVER (PARTITION BY video ORDER BY votes DESC, abs(delta), delta) = 1)"""


@query("stereo_offset", STEREO_SQL + " SELECT * FROM o")
def stereo_offset(spark: SparkSession, sf: str) -> DataFrame:
    return links.stereo_offset(sightings(spark, sf), "video", "taxon", "frame", "camera", 48)


@query("stereo_pairs", STEREO_SQL + """, c AS (SELECT video, taxon, frame, camera, count(*) n FROM s GROUP BY ALL), p AS (SELECT l.video, sum(least(l.n, r.n)) pairs FROM c l JOIN o ON o.video = l.video JOIN c r ON r.video = l.video AND r.taxon = l.taxon AND r.frame - o.delta = l.frame AND l.camera = 'L' AND r.camera = 'R' GROUP BY ALL)
SELECT t.video, coalesce(pairs, 0)::BIGINT pairs, total FROM (SELECT video, count(*) total FROM s GROUP BY ALL) t LEFT JOIN p ON p.video = t.video""")
def stereo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = sightings(spark, sf)
    return links.stereo_pairs(s, links.stereo_offset(s, "video", "taxon", "frame", "camera", 48), "video", "taxon", "frame", "camera")


@query("order_check", "SELECT * FROM (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day, max(epoch_us(o_orderdate) // 86400000000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(o_orderdate) // 86400000000 behind FROM orders) WHERE behind > 180")
def order_check(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"))
    return links.out_of_order(o, "o_custkey", "o_orderkey", "day", 180)


PLACES_SQL = "p AS (SELECT image_id, any_value(lat) lat, any_value(lon) lon, any_value(deployment) deployment FROM images WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) GROUP BY image_id)"
KM_SQL = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({0}.{2}) - radians({1}.{3})) / 2), 2) + cos(radians({0}.{2})) * cos(radians({1}.{3})) * pow(sin(radians({0}.{4} - {1}.{5}) / 2), 2))))"


def places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "images").filter(G.valid_position(F.col("lat"), F.col("lon"))).groupBy("image_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("deployment").alias("deployment"))


@query("grid_sites", f"""WITH RECURSIVE {PLACES_SQL}, q AS (SELECT * FROM p WHERE image_id % 3 = 0), e AS (SELECT a.image_id a, b.image_id b FROM p a JOIN p b ON a.image_id <> b.image_id AND abs(a.lat - b.lat) < 0.02 AND {KM_SQL.format('a', 'b', 'lat', 'lat', 'lon', 'lon')} <= 1.5),
r AS (SELECT image_id v, image_id root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v) SELECT v image_id, min(root) site FROM r GROUP BY v""".replace("q AS (SELECT * FROM p WHERE image_id % 3 = 0), ", ""))
def grid_sites(spark: SparkSession, sf: str) -> DataFrame:
    return links.grid_sites(places(spark, sf), "image_id", "lat", "lon", 1.5)


@query("spatial_spread", f"""WITH {PLACES_SQL}, c AS (SELECT deployment, count(*) n, quantile_cont(lat, 0.5) la, quantile_cont(lon, 0.5) lo FROM p WHERE deployment IS NOT NULL GROUP BY ALL),
d AS (SELECT p.deployment, {KM_SQL.format('p', 'c', 'lat', 'la', 'lon', 'lo')} km FROM p JOIN c ON c.deployment = p.deployment) SELECT c.deployment, any_value(n) n, any_value(la) centre_lat, any_value(lo) centre_lon, round(quantile_cont(km, 0.95), 4) p95_km FROM d JOIN c ON c.deployment = d.deployment GROUP BY ALL""")
def spatial_spread(spark: SparkSession, sf: str) -> DataFrame:
    return links.spread(places(spark, sf).filter("deployment is not null"), "deployment", "lat", "lon")


@query("latest_before", "SELECT event_id, user_id, e.ts::VARCHAR AS at, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts".replace("SELECT event_id, user_id,", "SELECT event_id, e.user_id,"))
def latest_before(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    right = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    out = links.nearest_before(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["last_value"])
    at = F.regexp_replace(F.col("ts").cast("string"), "$", "")
    return out.select("event_id", "user_id", at.alias("at"), "last_value")


@query("stratified_lock", f"{WITH}, r AS (SELECT key, source, row_number() OVER (PARTITION BY source ORDER BY sha256('lock:' || key), key) rn, count(*) OVER (PARTITION BY source) n FROM crops) SELECT key, source FROM r WHERE rn <= round_even(n * 0.3::DOUBLE, 0)")
def stratified_lock(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified(crops(spark, sf).select("key", "source"), ["source"], "key", 0.3, "lock")


@query("stride_sample", f"{WITH} SELECT key, species FROM crops QUALIFY (row_number() OVER (PARTITION BY species ORDER BY key) - 1) % 7 = 0")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stride(crops(spark, sf).select("key", "species"), ["species"], ["key"], 7)


@query("cap_per_group", f"{WITH} SELECT key, species FROM crops QUALIFY row_number() OVER (PARTITION BY species ORDER BY sha256('cap:' || key), key) <= 5")
def cap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.take_per_group(crops(spark, sf).select("key", "species"), ["species"], "key", 5, "cap")


@query("take_until", f"""{WITH}, p AS (SELECT genus, deployment, count(*) n FROM crops GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY genus ORDER BY sha256('t:' || genus || ':' || deployment), deployment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM p)
SELECT genus, deployment, n, CASE WHEN before < 20 THEN 'reference' ELSE 'query' END "role" FROM b""")
def take_until(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.take_until(crops(spark, sf), "genus", "deployment", 20, "t")


def _tries(name: str, rest: str, low: int, high: int) -> str:
    """The sides of tries low to high - 1 of the (d, species) of ``rest``, and the first that fits."""
    return f"""l{name} AS (SELECT *, CASE WHEN coalesce(sum(n) OVER (PARTITION BY d, t, species ORDER BY sha256('w:' || d || ':' || t || ':' || species || ':' || deployment), deployment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 THEN 'reference' ELSE 'query' END r
    FROM (SELECT p.*, d, t FROM {rest} JOIN p USING (species), range({low}, {high}) b(t))),
g{name} AS (SELECT d, species, min(t) t FROM (SELECT d, species, t FROM l{name} GROUP BY ALL HAVING coalesce(sum(n) FILTER (r = 'query'), 0) >= 10 AND coalesce(sum(n) FILTER (r = 'reference'), 0) >= 20) GROUP BY ALL),
c{name} AS (SELECT l.* FROM l{name} l JOIN g{name} USING (d, species, t))"""


# 1000 tries in three rounds; a species whose counts leave too few on one side whatever the order has no try
DRAWS_SQL = f"""{WITH}, p AS (SELECT species, deployment, count(*) n FROM crops GROUP BY ALL), s AS (SELECT d, species FROM (SELECT species FROM p GROUP BY species HAVING sum(n) >= 30 AND sum(n) - max(n) >= 10), range(10) a(d)),
{_tries("1", "s", 0, 4)}, s2 AS (FROM s ANTI JOIN g1 USING (d, species)), {_tries("2", "s2", 4, 32)}, s3 AS (FROM s2 ANTI JOIN g2 USING (d, species)), {_tries("3", "s3", 32, 1000)}, ch AS (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3),
m AS (SELECT l.d, l.species, l.t, l.deployment, k.key, l.r, row_number() OVER (PARTITION BY l.d, l.species, l.r ORDER BY sha256('w:' || l.d || ':' || k.key), k.key) rn FROM ch l JOIN crops k ON k.species = l.species AND k.deployment = l.deployment),
f AS (SELECT d::INT draw, species, t::INT try_no, deployment, key, r "role", CASE WHEN r = 'reference' THEN rn END ref_rank FROM m WHERE r = 'query' OR rn <= 20)"""


@query("make_draws", DRAWS_SQL + " SELECT draw, species, try_no, deployment, key, \"role\", ref_rank FROM f")
def make_draws(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.draws(crops(spark, sf), "species", "deployment", "key", 20, 10, 10, 1000, "w")


@query("draws_disjoint", DRAWS_SQL + " SELECT count(*) AS shared FROM (SELECT draw, species, deployment FROM f GROUP BY ALL HAVING count(DISTINCT \"role\") > 1)")
def draws_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    d = sampling.draws(crops(spark, sf), "species", "deployment", "key", 20, 10, 10, 1000, "w")
    return d.groupBy("draw", "species", "deployment").agg(F.count_distinct("role").alias("r")).filter("r > 1").agg(F.count("*").alias("shared"))


@query("draws_failed", DRAWS_SQL + ", u AS (SELECT species FROM p GROUP BY species HAVING sum(n) >= 30 AND sum(n) - max(n) >= 10), k AS (SELECT species, count(DISTINCT d) made FROM ch GROUP BY species) SELECT u.species, 10 - coalesce(made, 0) AS draws FROM u LEFT JOIN k USING (species) WHERE coalesce(made, 0) < 10")
def draws_failed(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.failed_draws(crops(spark, sf), "species", "deployment", 20, 10, 10, 1000, "w")


@query("match_shape", f"""{WITH}, b AS (SELECT key, source, (least(w, h) // 32)::INT bin FROM crops WHERE source IN ('A', 'R')), c AS (SELECT bin, count(*) FILTER (source = 'A')::DOUBLE ca, count(*) FILTER (source = 'R')::DOUBLE cb FROM b GROUP BY bin),
p AS (SELECT bin, ca, cb, least(ca / sum(ca) OVER (), cb / sum(cb) OVER ()) q FROM c), z AS (SELECT bin, ca, cb, q / sum(q) OVER () q FROM p WHERE q > 0), f AS (SELECT *, min(ca / q) OVER () fa, min(cb / q) OVER () fb FROM z),
u AS (SELECT bin, least(ca, floor(fa * q + 1e-9)) qa, least(cb, floor(fb * q + 1e-9)) qb FROM f), r AS (SELECT key, source, bin, row_number() OVER (PARTITION BY source, bin ORDER BY sha256('m:' || key), key) rn FROM b)
SELECT key, source, r.bin FROM r JOIN u ON u.bin = r.bin WHERE rn <= CASE source WHEN 'A' THEN qa ELSE qb END""")
def match_shape(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf).select("key", "source", F.least("w", "h").alias("short"))
    return sampling.match_shape(c, "source", "A", "R", F.floor(F.col("short") / 32).cast("int"), "key", "m").drop("short")


@query("quota_greedy")
def quota_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quota_greedy(crops(spark, sf).select(F.substring_index("key", "-", 1).cast("long").alias("image"), "genus"), "image", "genus", 40)


@query("readout_norm", f"{VEC} SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS head FROM v")
def readout_norm(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    both = vectors.readout([F.col("embedding"), F.reverse("embedding")])
    length = F.sqrt(vectors.dot(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double"))))
    return e.select("vec_id", F.round(length, 4).alias("length"), F.round(F.element_at(both, 1), 5).alias("head"))


UNIT_SQL = "u AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))) e FROM v)"
PROTO_SQL = f"""{VEC}, {UNIT_SQL}, x AS (SELECT label, unnest(e) v, generate_subscripts(e, 1) i FROM u WHERE vec_id % 2 = 0), t AS (SELECT label, i, sum(v) s FROM x GROUP BY ALL), n AS (SELECT label, list(s ORDER BY i) s FROM t GROUP BY label),
p AS (SELECT label, list_transform(s, lambda y: y / sqrt(list_sum(list_transform(s, lambda z: z * z)))) p FROM n)"""


@query("prototype_recall", PROTO_SQL + """, q AS (SELECT vec_id, u.label, p.label predicted FROM u JOIN p ON true WHERE vec_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(e, p), 9) DESC, p.label) = 1),
c AS (SELECT label, avg((predicted = label)::INT)::DOUBLE r, count(*) n FROM q GROUP BY label) SELECT round(avg(r), 6) macro_recall, count(*) n_classes, sum(n)::BIGINT n_queries FROM c""")
def prototype_recall(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    p = vectors.prototypes(e.filter("vec_id % 2 = 0"), "label", "embedding")
    return vectors.macro_recall(vectors.predictions(e.filter("vec_id % 2 = 1"), p, "vec_id", "label", "embedding"), "label")


@query("prototype_recall_constrained", PROTO_SQL + """, q AS (SELECT vec_id, u.label, p.label predicted FROM u JOIN p ON u.label // 4 = p.label // 4 WHERE vec_id % 2 = 1 AND u.label // 4 IN (SELECT label // 4 FROM p GROUP BY 1 HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(e, p), 9) DESC, p.label) = 1),
c AS (SELECT label, avg((predicted = label)::INT)::DOUBLE r, count(*) n FROM q GROUP BY label) SELECT round(avg(r), 6) macro_recall, count(*) n_classes, sum(n)::BIGINT n_queries FROM c""")
def prototype_recall_constrained(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    p = vectors.prototypes(e.filter("vec_id % 2 = 0"), "label", "embedding")
    parents = e.select("label", F.col("family").alias("parent")).distinct()
    return vectors.macro_recall(vectors.predictions(e.filter("vec_id % 2 = 1"), p, "vec_id", "label", "embedding", parents), "label")


def _side(key: str, other: str) -> str:
    return f"""(SELECT sum(s / n) / sum(v::DOUBLE / n) FROM (SELECT a.{key}, sum(CASE WHEN a.{other} <> b.{other} THEN list_inner_product(a.e, b.e) ELSE 0 END) s, count(*) FILTER (a.{other} <> b.{other}) v, count(*) n FROM u a JOIN u b ON a.{key} = b.{key} AND a.vec_id < b.vec_id GROUP BY ALL))"""


@query("leakage_margin", f"{VEC}, {UNIT_SQL}, m AS (SELECT round({_side('label', 'deployment')}, 6) same_species, round({_side('deployment', 'label')}, 6) same_group) SELECT same_species, same_group, round(same_species - same_group, 6) margin FROM m")
def leakage_margin(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.leakage(embedded(spark, sf), "label", "deployment", "embedding")


@query("linear_probe")
def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    return vectors.linear_probe(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "label", "embedding")


RES = f"WITH r AS ({RESULTS_SQL})"


@query("result_summary", f"{RES} SELECT level, candidate, round(avg(recall), 6) mean, round(min(recall), 6) low, round(max(recall), 6) high, round(stddev_samp(recall), 6) sd, count(recall) n FROM r GROUP BY ALL")
def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.summarise(results(spark, sf), ["level", "candidate"], "recall")


@query("two_stage_mean", f"{RES}, g AS (SELECT level, candidate, geometry, avg(recall) m FROM r GROUP BY ALL) SELECT level, candidate, round(avg(m), 6) mean FROM g GROUP BY ALL")
def two_stage_mean(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.two_stage_mean(results(spark, sf), ["level", "candidate"], "geometry", "recall")


@query("axis_attribution", f"{RES} SELECT 'candidate' axis, round(max(m) - min(m), 6) spread FROM (SELECT avg(recall) m FROM r GROUP BY candidate) UNION ALL SELECT 'geometry', round(max(m) - min(m), 6) FROM (SELECT avg(recall) m FROM r GROUP BY geometry)")
def axis_attribution(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    return decisions.axis_range(r, "candidate", "recall").unionByName(decisions.axis_range(r, "geometry", "recall"))


DECIDE_SQL = f"""{RES}, d AS (SELECT level, candidate, draw, avg(recall) v FROM r GROUP BY ALL), m AS (SELECT level, candidate, avg(v) m FROM d GROUP BY ALL), b AS (SELECT level, candidate best FROM m QUALIFY row_number() OVER (PARTITION BY level ORDER BY round(m, 9) DESC, candidate) = 1),
t AS (SELECT d.level, draw, v tv, best FROM d JOIN b ON b.level = d.level AND d.candidate = best), s AS (SELECT d.level, d.candidate, best, avg(v) mean, avg(round(tv - v, 9)) md, stddev_samp(round(tv - v, 9)) sd, count(*) n FROM d JOIN t ON t.level = d.level AND t.draw = d.draw GROUP BY ALL),
z AS (SELECT level, candidate, round(mean, 6) mean, best, NOT (CASE WHEN n < 2 THEN false WHEN coalesce(sd, 0) < 1e-12 THEN md > 1e-12 ELSE md / (sd / sqrt(n)) > 2.446911851144969 END) tied FROM s)"""


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    d = results(spark, sf).groupBy("level", "candidate", "draw").agg(F.avg("recall").alias("v"))
    return decisions.decide(d, "level", "candidate", "draw", "v", stats.t_quantile(spark, 0.975, 6))


@query("decide_levels", DECIDE_SQL + " SELECT * FROM z")
def decide_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)


@query("decide_winner", DECIDE_SQL + " SELECT candidate, round(avg(mean), 6) overall, count(*) FILTER (tied) levels_tied FROM z GROUP BY candidate ORDER BY overall DESC, candidate LIMIT 1")
def decide_winner(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.winner(_decided(spark, sf), "level", "candidate")


@query("rank_stability", f"""{RES}, p AS (SELECT level, candidate, avg(recall) FILTER (geometry = 0) x, avg(recall) FILTER (geometry = 1) y FROM r GROUP BY ALL), k AS (SELECT level, rank() OVER a + (count(*) OVER (PARTITION BY level, x) - 1) / 2 rx, rank() OVER b + (count(*) OVER (PARTITION BY level, y) - 1) / 2 ry FROM p WHERE x IS NOT NULL AND y IS NOT NULL WINDOW a AS (PARTITION BY level ORDER BY x), b AS (PARTITION BY level ORDER BY y))
SELECT level, count(*) n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END rho FROM k GROUP BY level""")
def rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).groupBy("level", "candidate").agg(F.avg(F.when(F.col("geometry") == 0, F.col("recall"))).alias("x"), F.avg(F.when(F.col("geometry") == 1, F.col("recall"))).alias("y"))
    return stats.spearman(r, ["level"], "x", "y")


@query("crop_records", """WITH i AS (SELECT image_id, any_value('fn-' || image_id) uid, any_value(CASE WHEN image_id % 2 = 0 THEN 'frame' ELSE 'cut_from_frame' END) prov FROM images GROUP BY ALL), a AS (SELECT image_id, image_id * 10 + n annotation_id FROM i, range(3) t(n) WHERE (image_id + n) % 4 <> 0)
SELECT uid || '-a' || annotation_id AS key, i.image_id, annotation_id FROM i JOIN a ON a.image_id = i.image_id WHERE prov = 'frame' UNION ALL SELECT uid, i.image_id, min(annotation_id) FROM i LEFT JOIN a ON a.image_id = i.image_id WHERE prov <> 'frame' GROUP BY ALL""")
def crop_records(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").select("image_id").distinct()
    images = i.select("image_id", F.concat(F.lit("fn-"), "image_id").alias("uid"), F.when(F.col("image_id") % 2 == 0, "frame").otherwise("cut_from_frame").alias("crop_provenance"))
    a = i.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).filter("(image_id + n) % 4 <> 0").select("image_id", (F.col("image_id") * 10 + F.col("n")).alias("annotation_id"))
    return shards.crop_records(images, a)


@query("shard_assignment", """WITH RECURSIVE d AS (SELECT coalesce(lang, '?') lang, doc_id, coalesce(n_chars, 0) n, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY doc_id) i FROM documents),
r AS (SELECT lang, doc_id, n, i, 0 shard, n held FROM d WHERE i = 1 UNION ALL SELECT d.lang, d.doc_id, d.n, d.i, CASE WHEN r.held >= 20000 THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.held >= 20000 THEN d.n ELSE r.held + d.n END FROM r JOIN d ON d.lang = r.lang AND d.i = r.i + 1)
SELECT lang, shard, count(*) records, sum(n)::BIGINT bytes FROM r GROUP BY ALL""")
def shard_assignment(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return shards.shard_manifest(shards.greedy_shards(d, "lang", "doc_id", "n", 20000), "lang", "n")


# a record per part: replacements, circles, missing records and doubtful statuses by its size
RECORDS_SQL = """SELECT p_partkey::BIGINT AS id, CASE WHEN p_size IN (13, 21) THEN NULL WHEN p_size > 36 OR p_size = 20 THEN p_partkey // 2 WHEN p_size BETWEEN 24 AND 30 THEN xor(p_partkey, 1) WHEN p_size = 9 THEN p_partkey + 100000000 ELSE p_partkey END::BIGINT AS valid,
    CASE WHEN p_size = 20 THEN 'Nomen dubium' WHEN p_size = 21 THEN 'taxon inquirendum' WHEN p_size = 13 OR p_size > 36 OR p_size BETWEEN 24 AND 30 OR p_size IN (9, 22) THEN 'unaccepted' ELSE 'accepted' END AS status FROM part"""
CHAIN_SQL = f"""WITH RECURSIVE e AS (SELECT id, lower(status) status, CASE WHEN valid <> 0 AND valid <> id THEN valid END choice, lower(status) IN ('alternate representation', 'nomen dubium', 'taxon inquirendum', 'uncertain', 'interim unpublished') doubt FROM ({RECORDS_SQL})),
w AS (SELECT id, id AS "at", 0 hops, [id] seen, status origin_status FROM e
UNION ALL SELECT w.id, e.choice, w.hops + 1, list_append(w.seen, e.choice), w.origin_status FROM w JOIN e ON e.id = w."at" WHERE e.status <> 'accepted' AND e.choice IS NOT NULL AND NOT list_contains(w.seen, e.choice) AND NOT (w.hops = 0 AND e.doubt) AND w.hops < 4),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) rn FROM w),
o AS (SELECT z.id, z."at", z.hops, z.origin_status, CASE WHEN e.id IS NULL OR z.hops = 0 AND e.doubt AND e.choice IS NOT NULL THEN 'review' WHEN e.status = 'accepted' AND z.hops = 0 THEN 'accepted' WHEN e.status = 'accepted' THEN 'remapped' WHEN e.choice IS NULL THEN 'kept' ELSE 'review' END outcome FROM z LEFT JOIN e ON e.id = z."at" WHERE rn = 1),
f AS (SELECT id, CASE outcome WHEN 'kept' THEN id WHEN 'review' THEN NULL ELSE "at" END AS final, "at" AS last, hops, origin_status, outcome FROM o)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    valid = F.when(size.isin(13, 21), F.lit(None)).when((size > 36) | (size == 20), F.floor(key / 2)).when(size.between(24, 30), key.bitwiseXOR(F.lit(1))).when(size == 9, key + 100000000).otherwise(key)
    status = F.when(size == 20, "Nomen dubium").when(size == 21, "taxon inquirendum").when(size.isin(13, 9, 22) | (size > 36) | size.between(24, 30), "unaccepted").otherwise("accepted")
    return table(spark, sf, "part").select(key.cast("long").alias("id"), valid.cast("long").alias("valid"), status.alias("status"))


@query("resolve_chain", CHAIN_SQL + " SELECT id, final, last, hops, origin_status, outcome FROM f")
def resolve_chain(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_accepted(_records(spark, sf)).drop("note")


@query("chain_merges", CHAIN_SQL + " SELECT final, count(*) n FROM f WHERE final IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def chain_merges(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.merges(resolve.resolve_accepted(_records(spark, sf)))


# what typed names map to: the parts of the order lines by brand and size
MAPPED_SQL = CHAIN_SQL + """, t AS (SELECT DISTINCT p_brand || '/' || p_size AS key, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN 0 WHEN p_size = 3 THEN p_partkey + 200000000 ELSE p_partkey END::BIGINT AS aphia_id FROM part),
m AS (SELECT key, aphia_id, CASE WHEN coalesce(aphia_id, 0) = 0 THEN aphia_id ELSE final END resolved, CASE WHEN coalesce(aphia_id, 0) = 0 THEN 'none' ELSE coalesce(outcome, 'review') END outcome, origin_status FROM t LEFT JOIN f ON f.id = t.aphia_id)"""


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    taxa = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("key"), F.when(size == 1, F.lit(None)).when(size == 2, 0).when(size == 3, F.col("p_partkey") + 200000000).otherwise(F.col("p_partkey")).cast("long").alias("aphia_id")).distinct()
    return resolve.resolve_map(taxa, _records(spark, sf))


@query("map_changes", MAPPED_SQL + " SELECT key, aphia_id, resolved, CASE outcome WHEN 'kept' THEN origin_status || ' (kept)' ELSE origin_status END AS status FROM m WHERE outcome IN ('remapped', 'kept')")
def map_changes(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.changes(_mapped(spark, sf))


@query("map_review", MAPPED_SQL + " SELECT key, aphia_id, origin_status FROM m WHERE outcome = 'review'")
def map_review(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.for_review(_mapped(spark, sf)).drop("note")


@query("map_merges", MAPPED_SQL + " SELECT resolved, count(*) n FROM m WHERE coalesce(resolved, 0) <> 0 GROUP BY ALL HAVING count(*) > 1")
def map_merges(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.merges(_mapped(spark, sf), "resolved")


@query("chain_audit", CHAIN_SQL + """, p AS (SELECT DISTINCT l_partkey::BIGINT id FROM lineitem WHERE l_linenumber > 2),
j AS (SELECT p.id, CASE WHEN f.outcome <> 'review' THEN f.last END AS final, coalesce(f.hops, 0) hops, coalesce(f.outcome, 'review') outcome, coalesce(f.origin_status, '') origin_status FROM p LEFT JOIN f ON f.id = p.id)
SELECT id, final, hops, CASE WHEN outcome = 'accepted' THEN 'ok' WHEN outcome <> 'review' AND final <> id AND origin_status = 'unaccepted' AND final IN (SELECT id FROM p) THEN 'merge' WHEN outcome <> 'review' AND final <> id AND origin_status = 'unaccepted' THEN 'rename' ELSE 'review' END AS action FROM j""")
def chain_audit(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.audit_chains(table(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_partkey").cast("long").alias("id")), _records(spark, sf))


NAMED_SQL = CHAIN_SQL + """, r AS (SELECT p.id, p.status, n.p_name AS name, n.p_brand AS valid_name, n.p_type AS taxon_rank FROM (""" + RECORDS_SQL + """) p JOIN part n ON n.p_partkey = p.id),
c AS (SELECT name, count(*) FILTER (status = 'accepted') good, count(*) a, min(id) FILTER (status = 'accepted') ga, min(id) aa FROM r GROUP BY name)"""


@query("names_to_records", NAMED_SQL + " SELECT c.name, f.final, r.valid_name, r.taxon_rank FROM c LEFT JOIN f ON f.id = CASE WHEN good = 1 THEN ga WHEN good = 0 AND a = 1 THEN aa END LEFT JOIN r ON r.id = f.final")
def names_to_records(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    named = part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("valid_name"), F.col("p_type").alias("taxon_rank"))
    return resolve.by_name(part.select(F.col("p_name").alias("name")), _records(spark, sf).join(named, "id"))


@query("post_merge_revive", "WITH t AS (SELECT l_partkey % 250 AS id, count(*) n FROM lineitem GROUP BY ALL), p AS (SELECT p_partkey, p_partkey % 250 AS id, p_size > 30 kept FROM part) SELECT p_partkey, (kept OR n >= 240) AS kept FROM p JOIN t ON t.id = p.id")
def post_merge_revive(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (F.col("p_partkey") % 250).alias("id"), (F.col("p_size") > 30).alias("kept"), F.coalesce("n", F.lit(0)).alias("n"))
    return resolve.revive(p, "id", "kept", "n", 240).select("p_partkey", "kept")


@query("unique_match", "WITH r AS (SELECT genus, taxon_rank, count(*) c, min(aphia_id) id FROM worms_names WHERE genus IS NOT NULL GROUP BY ALL HAVING count(*) = 1), n AS (SELECT DISTINCT genus, coalesce(taxon_rank, 'Genus') taxon_rank FROM fishwio WHERE genus IS NOT NULL) SELECT n.genus, n.taxon_rank, r.id AS \"match\" FROM n LEFT JOIN r ON r.genus = n.genus AND r.taxon_rank = n.taxon_rank")
def unique_match(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "fishwio").filter("genus is not null").select("genus", F.coalesce("taxon_rank", F.lit("Genus")).alias("taxon_rank")).distinct()
    return resolve.unique_match(names, table(spark, sf, "worms_names").withColumnRenamed("aphia_id", "id"), ["genus", "taxon_rank"])


@query("token_components", """WITH RECURSIVE e AS (SELECT DISTINCT 't' || o_custkey a, 't' || (o_custkey + o_orderkey % 3) b FROM orders), d AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a v, a root FROM d UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.v) SELECT v, min(root) root FROM r GROUP BY v""".replace("(o_custkey + o_orderkey % 3)", "(o_custkey // 4 * 4 + o_orderkey % 3)"))
def token_components(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return graph.components(o.select(F.concat(F.lit("t"), "o_custkey").alias("a"), F.concat(F.lit("t"), F.floor(F.col("o_custkey") / 4) * 4 + F.col("o_orderkey") % 3).alias("b")))


@query("greedy_cover")
def greedy_cover(spark: SparkSession, sf: str) -> DataFrame:
    counts = Scratch(spark, "cover").save(crops(spark, sf).groupBy(F.col("deployment").alias("group"), F.col("genus").alias("taxon")).agg(F.count("*").alias("units")), "counts")
    picked = resolve.greedy_cover(counts, 3, 6)
    return spark.createDataFrame([(i, int(g), n) for i, (g, n) in enumerate(picked)], "step int, deployment long, gain long")


@query("tumbling_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = sessions.windowed(table(spark, sf, "events"), "ts", ["event_type"], "1 hour")
    return w.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("user_sessions", "WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) s FROM p) SELECT user_id, count(DISTINCT s) sessions, count(*) n FROM s GROUP BY user_id")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions.sessions(table(spark, sf, "events"), "ts", ["user_id"], "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
