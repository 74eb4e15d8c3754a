"""Queries: parsers, groups, representatives, backgrounds and transfer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.functions.text import place_key
from tidemark.operators import groups as R
from tidemark.operators import profile
from tidemark.plans.core_b import KM_SQL, PLACES_SQL, places
from tidemark.plans.registry import query
from tidemark.plans.rehosted import CROPS_SQL, crops
from tidemark.session import table

WITH = f"WITH crops AS ({CROPS_SQL})"


@query("crop_file_names", f"{WITH} SELECT key, 'V_' || deployment AS video, species AS frame, w::BIGINT w, h::BIGINT h, (x - 900)::BIGINT x, y::BIGINT y FROM crops")
def crop_file_names(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("genus "), F.col("genus"))
    name = F.concat(F.lit("V_"), "deployment", F.lit("_"), "species", F.lit("_"), F.regexp_replace(label, " ", "_"), F.lit("_"), "w", F.lit("x"), "h", F.lit("+"), F.col("x") - 900, F.lit("+"), "y", F.lit(".JPG"))
    return crops(spark, sf).select("key", P.crop_file(name, label).alias("p")).select("key", "p.*")


@query("frame_crop_names", f"{WITH} SELECT key, 'A' || deployment AS video, camera, 'mp4' AS ext, species AS frame, x::BIGINT x0, y::BIGINT y0, w::BIGINT w, h::BIGINT h, 'A' AS survey FROM crops")
def frame_crop_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("A"), "deployment", F.lit("_"), F.lower("camera"), F.lit(".MP4."), "species", *[F.concat(F.lit("."), c) for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))], F.lit(".png"), F.when(F.col("species") % 2 == 0, "-7-7.png").otherwise(""))
    return crops(spark, sf).select("key", P.frame_crop(name).alias("p")).select("key", "p.*")


@query("opcode_groups", "SELECT deployment, string_split(deployment, '_')[1] site, string_split(deployment, '_')[1] || '_' || string_split(deployment, '_')[2] short FROM (SELECT DISTINCT deployment FROM dev_deployments WHERE source = 'yolo-bruv') WHERE len(string_split(deployment, '_')) >= 2")
def opcode_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dev_deployments").filter("source = 'yolo-bruv'").select("deployment").distinct()
    g = P.opcode_groups("deployment")
    return d.filter(g.isNotNull()).select("deployment", g["site"].alias("site"), g["deployment"].alias("short"))


@query("safe_names", "SELECT DISTINCT deployment, regexp_replace(deployment, '[^A-Za-z0-9_.-]+', '_', 'g') safe, regexp_replace(deployment, '[^\\p{L}\\p{N}]', '_', 'g') folder FROM images WHERE deployment IS NOT NULL".replace("\\\\", "\\"))
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "images").filter("deployment is not null").select("deployment").distinct()
    return d.select("deployment", P.safe_name("deployment").alias("safe"), P.folder_name("deployment").alias("folder"))


@query("video_seconds", "SELECT image_id, any_value(regexp_extract(frame_url, '/([^/]+)/[0-9_]+\\.png$', 1) || '|' || replace(regexp_extract(frame_url, '/([0-9][0-9]_[0-9][0-9]_[0-9][0-9])_[0-9]+\\.png$', 1), '_', '|')) unit FROM images GROUP BY image_id".replace("\\\\", "\\"))
def video_seconds(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").dropDuplicates(["image_id"])
    as_video = F.regexp_replace("frame_url", r"/(\d\d)_(\d\d)_(\d\d)_(\d+)\.png$", "/cam.mp4.$1.$2.$3.$4.jpg")
    return i.select("image_id", P.video_second(as_video, F.col("image_id").cast("string")).alias("unit"))


@query("index_lists", "SELECT o_orderkey, unnest(list_sort(list_distinct(list_concat([o_orderkey % 7], range(o_orderkey % 5, o_orderkey % 5 + 4))))) AS i FROM (SELECT DISTINCT o_orderkey FROM orders)")
def index_lists(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey").distinct()
    text = F.concat(F.lit("# 99 notes\n"), F.col("o_orderkey") % 7, F.lit(", "), F.col("o_orderkey") % 5 + 3, F.lit("-"), F.col("o_orderkey") % 5)
    return o.select("o_orderkey", F.explode(P.index_list(text)).alias("i"))


@query("tile_sizes", f"{WITH} SELECT key, w::BIGINT w, h::BIGINT h FROM crops")
def tile_sizes(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.when(F.col("species") % 2 == 0, F.concat("w", F.lit("x"), "h")).otherwise(F.concat_ws(",", "x", "y", "w", "h"))
    return crops(spark, sf).select("key", P.tile_size(detail).alias("t")).select("key", "t.*")


@query("dive_tokens", "SELECT image_id, 'NOAA:EX1404:D' || (image_id % 30) AS token FROM images UNION SELECT image_id, 'NOAA:EX1404:D' || (image_id % 30 + 1) FROM images")
def dive_tokens(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").select("image_id").distinct()
    path = F.concat(F.lit("/x/EX1404_DIVE0"), F.col("image_id") % 30, F.lit("_0"), F.col("image_id") % 30 + 1, F.lit("/f.jpg"))
    return i.select("image_id", F.explode(P.dive_tokens(path)).alias("token"))


@query("gear_concepts", "SELECT p_partkey, regexp_matches(lower(p_name), 'equipment|sampler|manipulator|rov|vehicle|cable|rope|marker|lander|trap|net|frame|light|laser|thruster|arm|tool|sled|platform|mooring|sensor|camera|elevator|benchmark|transect') gear FROM part")
def gear_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", P.is_gear(F.col("p_name")).alias("gear"))


@query("image_exclusion", "SELECT crop_key, (count(*) FILTER (w > 0 AND h > 0) > 0 OR bool_or(byte_copied AND build_no = 5)) kept, bool_or(NOT (byte_copied AND build_no = 5) AND NOT coalesce(w > 0 AND h > 0, false)) unlabelled, count(*) FILTER (NOT (byte_copied AND build_no = 5) AND w > 0 AND h > 0) boxes FROM (SELECT *, native_width w, native_height h FROM shard_records) GROUP BY crop_key".replace("(count(*) FILTER (w > 0 AND h > 0) > 0", "(count(*) FILTER (NOT (byte_copied AND build_no = 5) AND w > 0 AND h > 0) > 0"))
def image_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.box_kinds(table(spark, sf, "shard_records"), "crop_key", F.col("byte_copied") & (F.col("build_no") == 5), "native_width", "native_height")


@query("representatives", f"""{WITH}, c AS (SELECT deployment, genus, CASE WHEN count(*) FILTER (camera = 'L') >= count(*) FILTER (camera = 'R') THEN 'L' ELSE 'R' END cam FROM crops GROUP BY ALL)
SELECT k.deployment, k.genus, min(key) AS key FROM crops k JOIN c ON c.deployment = k.deployment AND c.genus = k.genus AND c.cam = k.camera GROUP BY k.deployment, k.genus, species % 3""")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    return R.representatives(crops(spark, sf), "deployment", "genus", "camera", "key", F.col("species") % 3).select("deployment", "genus", "key")


@query("group_levels", "WITH m AS (SELECT deployment g, CASE order_no % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END lv, order_no % 3 = 0 ok FROM (SELECT source AS deployment, order_no FROM dev_deployments)) SELECT g AS \"group\", ['deployment', 'dive', 'date', 'cruise'][coalesce(max(lv) FILTER (ok), max(lv))] AS \"level\" FROM m GROUP BY g")
def group_levels(spark: SparkSession, sf: str) -> DataFrame:
    order = ["deployment", "dive", "date", "cruise"]
    d = table(spark, sf, "dev_deployments").select(F.col("source").alias("group"), F.element_at(F.array(*[F.lit(x) for x in order]), (F.col("order_no") % 4 + 1).cast("int")).alias("level"), (F.col("order_no") % 3 == 0).alias("ok"))
    return R.group_level(d, "group", "level", "ok", order)


@query("safe_groups", "SELECT deployment AS \"group\", len(list_filter(list_distinct(list(derived_level)), lambda x: x NOT IN ('date', 'project'))) > 0 safe FROM fn_dev_groups GROUP BY deployment")
def safe_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.safe_groups(table(spark, sf, "fn_dev_groups").withColumnRenamed("deployment", "group"), "group", "derived_level", ["date", "project"])


@query("date_links", "WITH r AS (SELECT owner_institution s, taken_at::DATE d, 't' || (image_id % 40) t, image_id % 3 = 0 ok FROM images WHERE owner_institution IS NOT NULL AND taken_at IS NOT NULL), k AS (SELECT s, d, min(t) FILTER (ok) b FROM r GROUP BY ALL HAVING bool_or(ok) AND NOT bool_and(ok)) SELECT DISTINCT r.t a, k.b FROM r JOIN k ON k.s = r.s AND k.d = r.d WHERE r.t <> k.b")
def date_links(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "images").filter("owner_institution is not null").select(F.col("owner_institution").alias("s"), F.to_date("taken_at").alias("d"), F.concat(F.lit("t"), F.col("image_id") % 40).alias("t"), (F.col("image_id") % 3 == 0).alias("ok"))
    return R.date_links(r, "s", "d", "t", "ok")


@query("position_links", f"WITH {PLACES_SQL}, c AS (SELECT deployment t, quantile_cont(lat, 0.5) la, quantile_cont(lon, 0.5) lo FROM p WHERE deployment IS NOT NULL GROUP BY ALL) SELECT p.image_id, c.t AS token FROM p JOIN c ON abs(p.lat - c.la) < 0.1 AND {KM_SQL.format('p', 'c', 'lat', 'la', 'lon', 'lo')} <= 5")
def position_links(spark: SparkSession, sf: str) -> DataFrame:
    p = places(spark, sf)
    centres = p.filter("deployment is not null").groupBy(F.lit("all").alias("space"), F.col("deployment").alias("token")).agg(F.percentile("lat", F.lit(0.5)).alias("lat"), F.percentile("lon", F.lit(0.5)).alias("lon"))
    return R.position_links(p.withColumn("space", F.lit("all")), centres, "space", "image_id", "token", 5.0)


@query("frame_routes", """WITH f AS (SELECT file_name, deployment d, width w, min(image_id) v FROM images GROUP BY ALL), q AS (SELECT image_id i, CASE WHEN image_id % 3 = 0 THEN file_name ELSE file_name || '?' END file_name, deployment d, CASE WHEN image_id % 5 = 0 THEN -1 ELSE width END w FROM images GROUP BY ALL),
e AS (SELECT file_name, min(v) v FROM f GROUP BY ALL), l AS (SELECT d, w, v FROM f QUALIFY row_number() OVER (PARTITION BY d, w ORDER BY file_name, v) = 1)
SELECT q.i, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'loose' ELSE 'none' END route, coalesce(e.v, l.v) v FROM q LEFT JOIN e ON e.file_name = q.file_name LEFT JOIN l ON l.d = q.d AND l.w = q.w""")
def frame_routes(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").groupBy("file_name", F.col("deployment").alias("d"), F.col("width").alias("w")).agg(F.min("image_id").alias("v"))
    q = table(spark, sf, "images").select(F.col("image_id").alias("i"), F.when(F.col("image_id") % 3 == 0, F.col("file_name")).otherwise(F.concat("file_name", F.lit("?"))).alias("file_name"), F.col("deployment").alias("d"), F.when(F.col("image_id") % 5 == 0, -1).otherwise(F.col("width")).alias("w")).distinct()
    return R.fallback_lookup(q, i, "file_name", ["d", "w"], "v").select("i", "route", "v")


UNI = "(concat('0x', substr(sha256('bg:' || {0}), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE"


@query("place_backgrounds", f"""{WITH}, f AS (SELECT DISTINCT species fr FROM crops), s AS (SELECT fr, [[200, 150], [600, 400], [64, 64]][(floor({UNI.format("'size:' || fr")} * 3) + 1)::INT] sz FROM f), p AS (SELECT fr, t::INT t, sz[1] w, sz[2] h, floor({UNI.format("'x:' || t || ':' || fr")} * (1920 - sz[1] + 1))::INT x, floor({UNI.format("'y:' || t || ':' || fr")} * (1080 - sz[2] + 1))::INT y FROM s, range(60) r(t)),
c AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM crops b WHERE b.species = p.fr AND p.x < b.x + b.w + 8 AND b.x - 8 < p.x + p.w AND p.y < b.y + b.h + 8 AND b.y - 8 < p.y + p.h)) SELECT fr AS frame, w, h, x, y FROM c QUALIFY row_number() OVER (PARTITION BY fr ORDER BY t) = 1""")
def place_backgrounds(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf).select(F.col("species").alias("frame"), "x", "y", "w", "h")
    frames = c.select("frame", F.lit(1920).alias("width"), F.lit(1080).alias("height")).distinct()
    return R.place_backgrounds(frames, c, "frame", [(200, 150), (600, 400), (64, 64)], 8, 60, "bg")


@query("testable_k", f"""{WITH}, p AS (SELECT genus, deployment, count(*) n FROM crops GROUP BY ALL), t AS (SELECT genus, sum(n) total, max(n) big, count(*) g FROM p GROUP BY genus)
SELECT genus, max(k) k FROM t, (VALUES (1), (5), (20), (50), (100)) v(k) WHERE total >= k + 10 AND total - big >= 10 AND g >= 3 GROUP BY genus""")
def testable_k(spark: SparkSession, sf: str) -> DataFrame:
    return R.testable_k(crops(spark, sf), "genus", "deployment", [1, 5, 20, 50, 100], 10, 3)


@query("lock_draw", f"""{WITH}, p AS (SELECT source, deployment, count(*) n FROM crops GROUP BY ALL), z AS (SELECT *, count(*) OVER (PARTITION BY source) size FROM p), e AS (SELECT z.*, s::INT seed, row_number() OVER (PARTITION BY s, source ORDER BY sha256(s || ':' || deployment), deployment) rn FROM z, range(10) r(s)),
d AS (SELECT * FROM e WHERE rn <= round_even(size * 0.3::DOUBLE, 0)), o AS (SELECT min(seed) s FROM (SELECT seed FROM (SELECT seed, source FROM d GROUP BY ALL HAVING sum(n) >= (SELECT count(*) * 0.07 FROM crops)) GROUP BY seed HAVING count(*) = (SELECT count(DISTINCT source) FROM crops))) SELECT seed, source, deployment FROM d WHERE seed = (SELECT s FROM o)""")
def lock_draw(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf)
    least = int(-(-c.count() * 7 // 100))
    return R.first_passing_seed(c, "source", "deployment", 0.3, 10, least)


@query("name_cascade", """WITH n AS (SELECT valid_name nm, min(aphia_id) v FROM worms_names GROUP BY ALL), c AS (SELECT vernacular nm, min(aphia_id) v FROM worms_names WHERE vernacular IS NOT NULL GROUP BY ALL), m AS (SELECT map_id, any_value(proposed_name) p FROM (SELECT DISTINCT map_id, proposed_name FROM fishwio) GROUP BY map_id)
SELECT map_id, coalesce(a.v, b.v, d.v) AS v, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 WHEN d.v IS NOT NULL THEN 2 END step FROM m LEFT JOIN n a ON a.nm = m.p LEFT JOIN c b ON b.nm = lower(m.p) LEFT JOIN n d ON d.nm = regexp_replace(m.p, ' spp?\\.?$', '')""".replace("\\\\", "\\"))
def name_cascade(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "worms_names")
    names, common = w.select(F.col("valid_name").alias("nm"), F.col("aphia_id").alias("v")), w.filter("vernacular is not null").select(F.col("vernacular").alias("nm"), F.col("aphia_id").alias("v"))
    m = table(spark, sf, "fishwio").select("map_id", "proposed_name").dropDuplicates(["map_id"])
    p = F.col("proposed_name")
    return R.cascade(m, [(p, names), (F.lower(p), common), (F.regexp_replace(p, r" spp?\.?$", ""), names)], "nm", "v").select("map_id", "v", "step")


@query("transfer_scores", f"""{WITH}, c AS (SELECT source, genus, avg(quantity) / 50 x, avg(w) / 600 b, count(DISTINCT species) n FROM crops GROUP BY ALL) SELECT source, genus, n, CASE WHEN n >= 3 THEN round(x, 6) END "cross", CASE WHEN n >= 3 THEN round(b, 6) END baseline, CASE WHEN n >= 3 THEN round(x - b, 6) END difference, CASE WHEN n >= 3 AND b > 0 THEN round(x / b, 6) END ratio, CASE WHEN n >= 3 THEN round(1.0::DOUBLE / n, 6) END chance FROM c""")
def transfer_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf).groupBy("source", "genus").agg((F.avg("quantity") / 50).alias("x"), (F.avg("w") / 600).alias("b"), F.count_distinct("species").alias("n"))
    return R.transfer_scores(c, ["source", "genus"], "x", "b", "n", 3)


@query("relative_differences", "SELECT vec_id, round(list_max(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) rel FROM embeddings")
def relative_differences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(R.relative_difference(F.col("embedding"), F.reverse("embedding")), 6).alias("rel"))


@query("survey_composition", f"{WITH} SELECT source, count(*) FILTER (survey = 0) s0, count(*) FILTER (survey = 1) s1, count(*) FILTER (survey = 2) s2, count(*) FILTER (survey = 3) s3 FROM crops GROUP BY source")
def survey_composition(spark: SparkSession, sf: str) -> DataFrame:
    return profile.composition(crops(spark, sf), "source", "survey", range(4), "s")


@query("place_keys", r"SELECT DISTINCT grp, replace(regexp_replace(trim(regexp_replace(concat(' ', regexp_replace(lower(trim(grp)), '[^a-z0-9]+', ' ', 'g')), '([^0-9])0+([0-9])', '\1\2', 'g')), '([0-9]) ([0-9])', '\1_\2', 'g'), ' ', '') AS key FROM split_crops WHERE grp <> ''")
def place_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "split_crops").filter("grp <> ''").select("grp", place_key("grp").alias("key")).distinct()


@query("offset_search", "WITH w AS (SELECT event_id i, user_id v, (epoch_us(ts) // 3600000000)::BIGINT f FROM events WHERE event_type = 'click'), h AS (SELECT DISTINCT user_id v, (epoch_us(ts) // 3600000000)::BIGINT f, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END camera FROM events WHERE event_type IS DISTINCT FROM 'click') SELECT i, (h.f - w.f)::INT delta, camera FROM w JOIN h ON w.v = h.v AND abs(h.f - w.f) <= 6 QUALIFY row_number() OVER (PARTITION BY i ORDER BY abs(h.f - w.f), h.f - w.f, camera) = 1")
def offset_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("v"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("f"), F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("camera"), F.col("event_type").eqNullSafe("click").alias("asks"))
    return R.offset_search(e.filter("asks").drop("camera"), e.filter("not asks"), ["v"], "f", "camera", "i", 6)


@query("only_in_block", "SELECT min(l_returnflag) source, l_orderkey AS concept, count(*) n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def only_in_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("concept"))
    return R.only_in_block(rows, "source", "concept")


@query("volume_estimate", "WITH p AS (SELECT l_returnflag s, l_orderkey i, count(*) b, max(l_quantity) z FROM lineitem GROUP BY ALL) SELECT s AS source, count(*) images, round(avg(b), 6) boxes_per_image, round(sum(b) / avg(b) * quantile_cont(z, 0.5), 4) bytes FROM p GROUP BY s")
def volume_estimate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("image"), "l_quantity")
    return R.volume_estimate(rows, "source", "image", "l_quantity")


@query("random_baseline", f"""{WITH}, c AS (SELECT deployment, genus, count(*) u FROM crops GROUP BY ALL), o AS (SELECT deployment, s::INT seed, row_number() OVER (PARTITION BY s ORDER BY sha256(s || ':' || deployment), deployment) rn FROM (SELECT DISTINCT deployment FROM c), range(5) r(s)),
h AS (SELECT seed, size, genus, sum(u) u FROM o JOIN (VALUES (5), (20), (40)) z(size) ON rn <= size JOIN c ON c.deployment = o.deployment GROUP BY ALL) SELECT seed, size, count(*) FILTER (u >= 20) covered FROM h GROUP BY ALL""")
def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf).groupBy("deployment", "genus").agg(F.count("*").alias("u"))
    return R.random_baseline(c, "deployment", "genus", "u", 20, [5, 20, 40], 5)


@query("counts_with_empties", "WITH b AS (SELECT o_orderkey, count(*) b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderpriority AS priority, count(*) images, coalesce(sum(b), 0)::BIGINT boxes, count(*) FILTER (b IS NULL) empties FROM orders LEFT JOIN b ON b.o_orderkey = orders.o_orderkey GROUP BY o_orderpriority")
def counts_with_empties(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("priority"))
    return R.counts_with_empties(o, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image")), "image", "priority")
