"""Queries: scalars, integrity, counts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import stats
from tidemark.functions import taxa as X
from tidemark.functions.text import norm, seed64, uid, url_name
from tidemark.operators import integrity, profile, units
from tidemark.plans.rehosted import CROPS_SQL, crops
from tidemark.plans.registry import query
from tidemark.session import table

WITH = f"WITH crops AS ({CROPS_SQL})"


@query("evaluable_species", f"{WITH}, p AS (SELECT species, deployment, count(*) n FROM crops GROUP BY ALL) SELECT species, sum(n)::BIGINT total, max(n) largest FROM p GROUP BY species HAVING sum(n) >= 30 AND sum(n) - max(n) >= 10")
def evaluable_species(spark: SparkSession, sf: str) -> DataFrame:
    return units.usable(crops(spark, sf), "species", "deployment", 20, 10)


@query("reference_ready", f"{WITH} SELECT species, count(*) total, count(DISTINCT deployment) \"groups\" FROM crops GROUP BY species HAVING count(*) >= 20 AND count(DISTINCT deployment) >= 3")
def reference_ready(spark: SparkSession, sf: str) -> DataFrame:
    return units.reference_ready(crops(spark, sf), "species", "deployment", 20, 3)


@query(
    "gate_sweep",
    f"""{WITH}, s AS (SELECT species, genus, count(*) n, count(DISTINCT deployment) g FROM crops GROUP BY ALL),
b AS (SELECT * FROM (VALUES (10), (20), (50), (100)) c(min_crops), (VALUES (0), (1), (2), (3)) g(min_groups)),
p AS (SELECT min_crops, min_groups, genus, count(*) s FROM s JOIN b ON n >= min_crops AND g >= min_groups GROUP BY ALL)
SELECT min_crops, min_groups, sum(s)::BIGINT species, count(*) FILTER (s >= 2) genera2, count(*) FILTER (s >= 3) genera3, coalesce(sum(s) FILTER (s >= 2), 0)::BIGINT species_in_genera2 FROM p GROUP BY ALL""",
)
def gate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return units.gate_sweep(crops(spark, sf), "species", "genus", "deployment", [10, 20, 50, 100], [0, 1, 2, 3])


@query(
    "levels_material",
    f"""{WITH}, u AS (SELECT DISTINCT species, genus, family, ord FROM crops)
SELECT 'genus' AS level, count(*) parents FROM (SELECT genus FROM u GROUP BY genus HAVING count(DISTINCT species) >= 2) UNION ALL
SELECT 'family', count(*) FROM (SELECT family FROM u GROUP BY family HAVING count(DISTINCT genus) >= 2) UNION ALL
SELECT 'ord', count(*) FROM (SELECT ord FROM u GROUP BY ord HAVING count(DISTINCT family) >= 2)""",
)
def levels_material(spark: SparkSession, sf: str) -> DataFrame:
    return units.levels_material(crops(spark, sf).select("species", "genus", "family", "ord").distinct(), ["species", "genus", "family", "ord"])


@query("units_max_lr", f"{WITH} SELECT deployment, species, greatest(count(*) FILTER (camera = 'L'), count(*) FILTER (camera = 'R')) units FROM crops GROUP BY ALL")
def units_max_lr(spark: SparkSession, sf: str) -> DataFrame:
    return units.camera_units(crops(spark, sf), "deployment", "species", "camera")


@query(
    "stereo_balance",
    f"""{WITH}, c AS (SELECT deployment, genus, count(*) FILTER (camera = 'L') l, count(*) FILTER (camera = 'R') r FROM crops GROUP BY ALL)
SELECT count(*) "both", count(*) FILTER (l = r) equal, count(*) FILTER (abs(l - r) <= greatest(l, r) * 0.1) within_tenth FROM c WHERE l > 0 AND r > 0""",
)
def stereo_balance(spark: SparkSession, sf: str) -> DataFrame:
    return units.stereo_balance(crops(spark, sf), "deployment", "genus", "camera")


@query(
    "per_source_strength",
    f"""{WITH}, p AS (SELECT source, genus, species, count(*) n, count(DISTINCT deployment) g FROM crops GROUP BY ALL), q AS (SELECT source, genus, count(*) FILTER (n >= 12 AND g >= 3) strong, count(*) FILTER (n >= 8) wide FROM p GROUP BY ALL)
SELECT source, sum(strong)::BIGINT strong, count(*) FILTER (wide >= 2) genera FROM q GROUP BY source""",
)
def per_source_strength(spark: SparkSession, sf: str) -> DataFrame:
    return units.per_source_strength(crops(spark, sf), "source", "species", "genus", "deployment", 12, 3, 8)


@query("cross_source_shared", f"{WITH}, d AS (SELECT DISTINCT source, species FROM crops) SELECT a.source source_a, b.source source_b, count(*) shared FROM d a JOIN d b ON a.species = b.species AND a.source < b.source GROUP BY ALL")
def cross_source_shared(spark: SparkSession, sf: str) -> DataFrame:
    return units.shared_between(crops(spark, sf), "source", "species")


@query(
    "genera_list",
    f"""{WITH}, p AS (SELECT genus, species, count(*) w FROM crops GROUP BY ALL HAVING count(*) >= 20) SELECT genus, count(*) n, string_agg(species::VARCHAR, '|' ORDER BY w DESC, species) listed FROM p GROUP BY genus""",
)
def genera_list(spark: SparkSession, sf: str) -> DataFrame:
    return units.children_list(crops(spark, sf), "genus", "species", F.count("*"), 20)


@query(
    "transfer_pools",
    f"""{WITH}, r AS (SELECT source sa, genus FROM crops GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT deployment) >= 3),
p AS (SELECT source, genus, deployment, count(*) c FROM crops GROUP BY ALL), q AS (SELECT source sb, genus, sum(c) n, max(c) m FROM p GROUP BY ALL HAVING sum(c) >= 10)
SELECT sa source_a, sb source_b, count(DISTINCT genus) taxa FROM r JOIN q USING (genus) WHERE sa <> sb OR (n >= 30 AND n - m >= 10) GROUP BY ALL""",
)
def transfer_pools(spark: SparkSession, sf: str) -> DataFrame:
    return units.transfer_pools(crops(spark, sf), "genus", "deployment", "source", 20, 10, 3)


@query(
    "finest_group_level",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN c_name WHEN o_orderpriority LIKE '2%' THEN n_name ELSE r_name END AS "group" FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def finest_group_level(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    first, second = F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority").startswith("2")
    return j.select("o_orderkey", integrity.finest_level([F.when(first, F.col("c_name")).otherwise(""), F.when(second, F.col("n_name")), F.col("r_name")]).alias("group"))


@query(
    "source_rollup",
    """SELECT source, lang, count(*) docs, count(DISTINCT text) texts, count(*) FILTER (text IS NULL OR text = '') empties, round(100.0 * count(deployment) / count(*), 4)::DOUBLE placed_pct, (grouping(source) + grouping(lang))::BIGINT level FROM documents GROUP BY ROLLUP (source, lang)""",
)
def source_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return profile.rollup_counts(table(spark, sf, "documents"), ["source", "lang"], "text", "deployment")


@query("camera_cube", f"{WITH} SELECT source, camera, count(*) n, (grouping(source) * 2 + grouping(camera))::BIGINT gid FROM crops GROUP BY CUBE (source, camera)")
def camera_cube(spark: SparkSession, sf: str) -> DataFrame:
    return profile.cube_counts(crops(spark, sf), ["source", "camera"])


@query("category_by_source", f"{WITH} SELECT species, string_agg(DISTINCT source, '|' ORDER BY source) sources, count(*) crops, count(DISTINCT deployment) deployments, min(least(w, h)) smallest FROM crops GROUP BY species")
def category_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return profile.category_profile(crops(spark, sf), "species", "source", "deployment", F.least("w", "h")).withColumnRenamed("groups", "deployments")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_text", "SELECT sha256(text) digest, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_text(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.duplicates(table(spark, sf, "documents").filter("text is not null").select(F.sha2("text", 256).alias("digest")), ["digest"])


@query("orphans_fk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphans_fk(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").filter("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query(
    "key_reconcile",
    """WITH a AS (SELECT crop_key, min(deployment) a FROM shard_records GROUP BY ALL), b AS (SELECT crop_key, min(grp) b FROM split_crops GROUP BY ALL)
SELECT CASE WHEN b.crop_key IS NULL THEN 'missing' WHEN a.crop_key IS NULL THEN 'extra' WHEN a IS DISTINCT FROM b THEN 'differs' ELSE 'same' END status, count(*) n FROM a FULL JOIN b ON a.crop_key = b.crop_key GROUP BY ALL""",
)
def key_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    built = table(spark, sf, "split_crops").withColumnRenamed("grp", "deployment")
    return integrity.reconcile(table(spark, sf, "shard_records"), built, "crop_key", "deployment")


@query(
    "field_presence",
    """WITH l AS (UNPIVOT (SELECT coalesce(owner_institution, 'none') inst, coalesce(deployment, '') deployment, coalesce(lat::VARCHAR, '') lat, coalesce(depth_m::VARCHAR, '') depth_m FROM images) ON deployment, lat, depth_m INTO NAME field VALUE value)
SELECT inst, field, count(*) FILTER (value <> '') filled, count(DISTINCT nullif(value, '')) distinct_values FROM l GROUP BY ALL""",
)
def field_presence(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").withColumn("inst", F.coalesce("owner_institution", F.lit("none")))
    return integrity.presence(i, ["deployment", "lat", "depth_m"], "inst")


@query("legend_top", "WITH c AS (SELECT deployment, count(*) n FROM images WHERE deployment IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, deployment) k FROM c) SELECT CASE WHEN k <= 8 THEN deployment ELSE 'other' END \"label\", sum(n)::BIGINT n FROM r GROUP BY ALL")
def legend_top(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.top_or_other(table(spark, sf, "images"), "deployment", 8)


@query("dense_codes", "SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT code FROM (SELECT DISTINCT p_brand FROM part)")
def dense_codes(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.dense_codes(table(spark, sf, "part"), "p_brand")


@query(
    "append_images",
    """WITH held AS (SELECT file_name, min(image_id) id FROM images WHERE owner_institution = 'NORVIK' GROUP BY ALL), new AS (SELECT DISTINCT file_name FROM images) SELECT count(*) n, count(DISTINCT id) ids, max(id) top FROM
(SELECT id FROM held UNION ALL SELECT (SELECT max(id) FROM held) + row_number() OVER (ORDER BY file_name) FROM new WHERE file_name NOT IN (SELECT file_name FROM held))""",
)
def append_images(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "images")
    held = images.filter("owner_institution = 'NORVIK'").groupBy("file_name").agg(F.min("image_id").alias("id"))
    both = integrity.upsert(held, images.select("file_name", F.lit(None).cast("long").alias("id")), "file_name", "id")
    return both.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("id").alias("top"))


@query("uid_hash", r"SELECT image_id, 'fn-' || substr(sha256(replace(file_name, '\', '/')), 1, 10) AS uid FROM images")
def uid_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "images").select("image_id", uid("fn", "file_name").alias("uid"))


@query("seed64", "SELECT doc_id, concat('0x', substr(sha256('7|' || doc_id), 1, 16))::UBIGINT::DECIMAL(20,0)::VARCHAR AS seed FROM documents")
def seed64_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", seed64(F.lit(7), F.col("doc_id")).cast("string").alias("seed"))


@query("norm_null_tokens", "SELECT map_id, CASE WHEN upper(trim(coalesce(proposed_name, ''))) IN ('', 'NA', 'NAN', 'NULL', 'NONE') THEN '' ELSE trim(coalesce(proposed_name, '')) END AS name FROM fishwio")
def norm_null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fishwio").select("map_id", norm("proposed_name").alias("name"))


@query("url_template", "SELECT regexp_replace(frame_url, '[0-9]+', '#', 'g') AS template, count(*) n FROM images GROUP BY ALL")
def url_template(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "images").groupBy(X.url_template("frame_url").alias("template")).agg(F.count("*").alias("n"))


@query("url_segments", "WITH s AS (SELECT owner_institution, string_split(frame_url, '/') p FROM images), u AS (SELECT owner_institution, unnest(p) seg, generate_subscripts(p, 1) pos FROM s) SELECT owner_institution, pos::INT pos, count(DISTINCT seg) segments FROM u GROUP BY ALL")
def url_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "images").select("owner_institution", F.posexplode(F.split("frame_url", "/")).alias("p", "seg"))
    return s.groupBy("owner_institution", (F.col("p") + 1).alias("pos")).agg(F.count_distinct("seg").alias("segments"))


@query("frame_names", "SELECT image_id, concat(lower(regexp_extract(u, '^([^/]*)', 1)), regexp_extract(u, '^[^/]*(.*)$', 1)) frame FROM (SELECT image_id, url_decode(regexp_replace(frame_url, '^https?://', '')) u FROM images)")
def frame_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "images").select("image_id", url_name("frame_url").alias("frame"))


@query(
    "rank_intent",
    """WITH t AS (SELECT map_id, trim(coalesce(family, '')) f, trim(coalesce(genus, '')) g, trim(coalesce(species, '')) s FROM fishwio)
SELECT map_id, CASE WHEN g <> '' AND regexp_matches(s, '^[a-z][a-z\\-]+$') AND s NOT IN ('sp', 'spp') THEN 'Species' WHEN g <> '' THEN 'Genus' WHEN f <> '' THEN 'Family' END "rank",
CASE WHEN g <> '' AND regexp_matches(s, '^[a-z][a-z\\-]+$') AND s NOT IN ('sp', 'spp') THEN g || ' ' || s WHEN g <> '' THEN g WHEN f <> '' THEN f END proposed FROM t""".replace("\\\\", "\\"),
)
def rank_intent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fishwio").select("map_id", X.rank_intent("family", "genus", "species").alias("rank"), X.propose_name("family", "genus", "species").alias("proposed"))


@query(
    "target_size",
    f"""{WITH}, s AS (SELECT key, w, h, greatest(w, h) lo, least(w, h) sh FROM crops), t AS (SELECT key, w, h, lo, CASE WHEN sh * (300.0 / lo) < 64 THEN 64.0 / sh ELSE 300.0 / lo END sc FROM s)
SELECT key, CASE WHEN lo > 300 AND sc < 1 THEN greatest(1, round_even(w * sc, 0)::INT) END tw, CASE WHEN lo > 300 AND sc < 1 THEN greatest(1, round_even(h * sc, 0)::INT) END th FROM t""".replace("300.0", "300.0::DOUBLE").replace("64.0", "64.0::DOUBLE"),
)
def target_size(spark: SparkSession, sf: str) -> DataFrame:
    tw, th = G.target_size(F.col("w"), F.col("h"), 300, 64)
    return crops(spark, sf).select("key", tw.alias("tw"), th.alias("th"))


@query(
    "square_geometry",
    f"""{WITH}, a AS (SELECT key, x, y, w, h, greatest(w, h) lo, round_even(greatest(w, h) * 1.1::DOUBLE, 0)::INT ws FROM crops),
b AS (SELECT *, CASE WHEN ws <= 400 THEN 'fits' WHEN lo <= 400 THEN 'margin_reduced' ELSE 'padded' END tier, CASE WHEN ws <= 400 THEN ws WHEN lo <= 400 THEN 400 ELSE lo END side FROM a),
c AS (SELECT *, round_even(x + w / 2 - side / 2, 0)::INT ix, round_even(y + h / 2 - side / 2, 0)::INT iy FROM b),
d AS (SELECT *, CASE WHEN side <= 1920 THEN least(greatest(ix, 0), 1920 - side) ELSE ix END sx, CASE WHEN side <= 400 THEN least(greatest(iy, 0), 400 - side) ELSE iy END sy FROM c)
SELECT key, side, sx, sy, tier, (sx <> ix OR sy <> iy) shifted, round(1 - ((least(1920, sx + side) - greatest(0, sx)) * (least(400, sy + side) - greatest(0, sy)))::DOUBLE / (side * side), 6) pad_fraction FROM d""",
)
def square_geometry(spark: SparkSession, sf: str) -> DataFrame:
    s = G.square_for(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(400), 0.1)
    return crops(spark, sf).select("key", s.alias("s")).select("key", "s.*")


@query(
    "clip_box",
    f"""{WITH}, a AS (SELECT key, greatest(0, x - 30) x0, greatest(0, y - 30) y0, least(1500, x - 30 + w) x1, least(800, y - 30 + h) y1 FROM crops) SELECT key, x0, y0, x1, y1 FROM a WHERE x1 - x0 >= 2 AND y1 - y0 >= 2""",
)
def clip_box(spark: SparkSession, sf: str) -> DataFrame:
    box = G.clip_box(F.col("x") - 30, F.col("y") - 30, F.col("w"), F.col("h"), F.lit(1500), F.lit(800))
    return crops(spark, sf).select("key", box.alias("b")).filter("b is not null").select("key", "b.*")


@query("clamp_box", f"""{WITH}, a AS (SELECT key, x, y, w, h, least(greatest(x, 0), 1500) cx, least(greatest(y, 0), 800) cy FROM crops), b AS (SELECT *, greatest(0, least(x + w, 1500) - cx) cw, greatest(0, least(y + h, 800) - cy) ch FROM a)
SELECT key, cx x, cy y, cw w, ch h, (cx <> x OR cy <> y OR cw <> w OR ch <> h) clamped FROM b""")
def clamp_box(spark: SparkSession, sf: str) -> DataFrame:
    return crops(spark, sf).select("key", G.clamp_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1500), F.lit(800)).alias("b")).select("key", "b.*")


@query("patch_grid")
def patch_grid(spark: SparkSession, sf: str) -> DataFrame:
    return crops(spark, sf).select("key", G.patch_grid(F.col("w"), F.col("h"), 16, 256).alias("p")).select("key", "p.w", "p.h")


PCT_SQL = f"""{WITH}, s AS (SELECT source, least(w, h)::DOUBLE v FROM crops), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v) - 1 i, count(*) OVER (PARTITION BY source) n FROM s)
SELECT source, any_value(n) n, round(quantile_cont(v, 0.9), 6) linear, min(v) FILTER (i = round_even(0.9 * (n - 1), 0)) nearest, min(v) FILTER (i = least(n - 1, floor(0.9::DOUBLE * n))) scaled, min(v) FILTER (i = floor(0.9::DOUBLE * (n - 1))) "lower", min(v) FILTER (i = n * 9 // 10) tenth FROM r GROUP BY source"""


@query("size_percentiles", PCT_SQL)
def size_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentile_table(crops(spark, sf).select("source", F.least("w", "h").alias("v0")), ["source"], "v0", 0.9)


@query(
    "size_summary",
    f"""{WITH}, l AS (SELECT source, 'short' def, least(w, h) v FROM crops UNION ALL SELECT source, 'long', greatest(w, h) FROM crops UNION ALL SELECT source, 'width', w FROM crops UNION ALL SELECT source, 'height', h FROM crops)
SELECT source, def "definition", count(*) n, quantile_disc(v, 0.1)::DOUBLE p10, quantile_disc(v, 0.5)::DOUBLE median, quantile_disc(v, 0.9)::DOUBLE p90, round(100.0::DOUBLE * count(*) FILTER (v < 64) / count(*), 4) under_64_pct, round(100.0::DOUBLE * count(*) FILTER (v < 32) / count(*), 4) under_32_pct FROM l GROUP BY ALL""",
)
def size_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = crops(spark, sf).select("source", F.expr("stack(4, 'short', least(w, h), 'long', greatest(w, h), 'width', w, 'height', h) as (definition, v)"))
    return profile.size_summary(long, ["source", "definition"], "v")


@query(
    "cap_cost",
    f"""{WITH}, c AS (SELECT cap, greatest(w, h) lo, least(w, h) sh FROM crops, (VALUES (128), (256), (384)) t(cap)) SELECT cap, count(*) FILTER (lo > cap) touched, count(*) FILTER (lo > cap AND sh * (cap::DOUBLE / lo) < 64) short_after, round(min(sh * (cap::DOUBLE / lo)) FILTER (lo > cap), 6) worst FROM c GROUP BY cap""",
)
def cap_cost(spark: SparkSession, sf: str) -> DataFrame:
    return profile.cap_cost(crops(spark, sf), F.greatest("w", "h"), F.least("w", "h"), (128, 256, 384), 64)


@query("size_histogram", "SELECT floor(log2(n_chars) * 8)::BIGINT AS bin, count(*) n FROM documents WHERE n_chars > 0 GROUP BY ALL")
def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.log_histogram(table(spark, sf, "documents"), "n_chars")


@query("auc_size", f"""{WITH}, r AS (SELECT least(w, h)::DOUBLE v, camera = 'L' p FROM crops), k AS (SELECT v, p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 rk FROM r),
a AS (SELECT (sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p)::DOUBLE * count(*) FILTER (NOT p)) u, count(*) FILTER (p) np, count(*) FILTER (NOT p) nq FROM k)
SELECT round(u, 6) auc, greatest(round(u, 6), 1 - round(u, 6)) folded, np n_positive, nq n_negative FROM a""")
def auc_size(spark: SparkSession, sf: str) -> DataFrame:
    return stats.auc(crops(spark, sf).select(F.least("w", "h").alias("v"), (F.col("camera") == "L").alias("p")), "v", "p")


@query("size_match_sigma", f"""{WITH}, s AS (SELECT source, count(*)::DOUBLE n, avg((least(w, h) < 64)::INT)::DOUBLE p FROM crops GROUP BY ALL), t AS (SELECT avg((least(w, h) < 64)::INT)::DOUBLE p0, count(*)::DOUBLE n0 FROM crops)
SELECT source, round(p - p0, 6) drift, round((p - p0) / sqrt(p0 * (1 - p0) / least(n, n0)), 4) sigma FROM s, t""")
def size_match_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return profile.share_drift(crops(spark, sf), "source", F.least("w", "h") < 64)


@query("mixture_weights", f"""{WITH}, b AS (SELECT source, count(*)::DOUBLE boxes, count(DISTINCT deployment)::DOUBLE frames, avg((least(w, h) < 64)::INT)::DOUBLE under FROM crops GROUP BY ALL)
SELECT round(sum(boxes * under) / sum(boxes), 6) by_boxes, round(sum(frames * under) / sum(frames), 6) by_frames FROM b""")
def mixture_weights(spark: SparkSession, sf: str) -> DataFrame:
    return profile.mixture_shares(crops(spark, sf), "source", "deployment", F.least("w", "h") < 64)


@query("geo_bins", "SELECT floor(lat)::BIGINT la, floor(lon)::BIGINT lo, count(*) n FROM images WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) GROUP BY ALL")
def geo_bins(spark: SparkSession, sf: str) -> DataFrame:
    return profile.geo_bins(table(spark, sf, "images"), "lat", "lon")


@query("taxon_buckets", "SELECT map_id, CASE WHEN coalesce(family, '') = '' THEN 'unknown' WHEN length(family) % 3 = 0 THEN 'other' WHEN length(family) % 3 = 1 THEN 'vertebrate' ELSE CASE WHEN genus IS NULL THEN 'unknown' ELSE 'invertebrate' END END bucket FROM fishwio")
def taxon_buckets(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fishwio")
    m = F.length("family") % 3
    kingdom = F.when(F.coalesce("family", F.lit("")) == "", "").when(m == 0, "Plantae").otherwise("Animalia")
    return f.select("map_id", X.taxon_bucket(kingdom, F.lit("Chordata"), F.when(m == 1, "Teleostei").when(F.col("genus").isNull(), "").otherwise("Ascidiacea")).alias("bucket"))


@query("taxa_of_levels", "SELECT aphia_id, CASE WHEN taxon_rank = 'Species' THEN valid_name END species, CASE WHEN taxon_rank IN ('Species', 'Genus') THEN genus END genus, family FROM worms_names")
def taxa_of_levels(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "worms_names")
    t = X.taxa_of(F.col("valid_name"), F.col("taxon_rank"), F.map_filter(F.create_map(F.lit("Family"), F.col("family"), F.lit("Genus"), F.col("genus")), lambda _, v: v.isNotNull()))
    return w.select("aphia_id", *[F.try_element_at(t, F.lit(x)).alias(x) for x in ("species", "genus", "family")])


@query("lineage_gaps", "SELECT w.aphia_id, w.taxon_rank, (SELECT count(*) FROM fishwio f WHERE f.aphia_id = w.aphia_id) AS uses FROM worms_names w WHERE w.genus IS NULL OR w.family IS NULL")
def lineage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "fishwio").groupBy("aphia_id").agg(F.count("*").alias("u"))
    gaps = table(spark, sf, "worms_names").filter("genus is null or family is null")
    return gaps.join(uses, "aphia_id", "left").select("aphia_id", "taxon_rank", F.coalesce("u", F.lit(0)).alias("uses"))


@query("name_usage", "WITH e AS (SELECT 'genus' lvl, genus nm, aphia_id FROM worms_names WHERE genus IS NOT NULL UNION ALL SELECT 'family', family, aphia_id FROM worms_names WHERE family IS NOT NULL) SELECT lvl, nm, count(DISTINCT aphia_id) cats FROM e GROUP BY ALL")
def name_usage(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(F.lit("genus"), F.col("genus"), F.lit("family"), F.col("family"))
    return profile.name_usage(table(spark, sf, "worms_names"), "aphia_id", names).drop("crops")


@query("day_of_year", "SELECT image_id, (make_date(year(taken_at), 1, 1) + (dayofyear(taken_at) - 1)::INT)::VARCHAR AS day FROM images WHERE taken_at IS NOT NULL")
def day_of_year(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").filter("taken_at is not null")
    return i.select("image_id", X.day_of_year(F.year("taken_at"), F.dayofyear("taken_at")).cast("string").alias("day"))


@query("hemisphere_coords", "SELECT image_id, round(lat, 5) lat FROM images WHERE lat IS NOT NULL")
def hemisphere_coords(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").filter("lat is not null")
    text = F.concat(F.when(F.col("lat") < 0, "S").otherwise("N"), F.abs(F.round("lat", 5)).cast("string"))
    return i.select("image_id", X.hemisphere(text).alias("lat"))


@query("split_labels", "SELECT crop_key, CASE WHEN grp = '' THEN 'ungrouped' WHEN EXISTS (SELECT 1 FROM dev_deployments d WHERE d.deployment = grp AND d.source = s.source) THEN 'dev' ELSE 'main' END \"label\" FROM split_crops s")
def split_labels(spark: SparkSession, sf: str) -> DataFrame:
    dev = table(spark, sf, "dev_deployments").select("source", F.col("deployment").alias("grp"))
    return profile.split_of(table(spark, sf, "split_crops"), dev, ["source", "grp"]).select("crop_key", X.split_label(F.col("grp"), F.col("in_dev")).alias("label"))


@query("lock_labels", "SELECT crop_key, CASE WHEN lower(trim(coalesce(split, ''))) IN ('dev', 'ungrouped') THEN lower(trim(split)) WHEN sha256(grp) < '4' THEN 'lock' WHEN heldout_genus <> '' THEN 'heldout' ELSE 'train' END \"label\" FROM split_crops")
def lock_labels(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "split_crops")
    return s.select("crop_key", X.lock_label(F.lower(F.trim(F.coalesce("split", F.lit("")))), F.sha2("grp", 256) < "4", F.coalesce("heldout_genus", F.lit("")) != "").alias("label"))


@query("audit_rates", f"""{WITH}, a AS (SELECT source, CASE l WHEN '0' THEN 'wrong' WHEN '1' THEN 'unsure' ELSE 'right' END verdict FROM (SELECT source, substr(sha256(key), 1, 1) l FROM crops)) SELECT source, count(*) n, round(100.0::DOUBLE * count(*) FILTER (verdict = 'wrong') / count(*), 4) floor_pct,
round(100.0::DOUBLE * count(*) FILTER (verdict <> 'right') / count(*), 4) ceiling_pct, round(100.0::DOUBLE * count(*) FILTER (verdict = 'wrong') / nullif(count(*) FILTER (verdict <> 'unsure'), 0), 4) sure_pct FROM a GROUP BY source""")
def audit_rates(spark: SparkSession, sf: str) -> DataFrame:
    first = F.substring(F.sha2("key", 256), 1, 1)
    return profile.audit_rates(crops(spark, sf).select("source", F.when(first == "0", "wrong").when(first == "1", "unsure").otherwise("right").alias("v")), ["source"], "v")


@query("sheet_paging", f"{WITH}, r AS (SELECT key, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || key), key) - 1 i, source FROM crops) SELECT key, source, (i // 30 + 1)::INT sheet, (i % 30)::INT place FROM r")
def sheet_paging(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sheet_pages(crops(spark, sf), "source", "key", 30, 3)

@query("audit_rates_by_size", f"""{WITH}, a AS (SELECT source, floor(log2(least(w, h)))::INT AS bin, species % 3 AS taxon, CASE l WHEN '0' THEN 'wrong' WHEN '1' THEN 'unsure' ELSE 'right' END verdict FROM (SELECT *, substr(sha256(key), 1, 1) l FROM crops)) SELECT bin, taxon, count(*) n, round(100.0::DOUBLE * count(*) FILTER (verdict = 'wrong') / count(*), 4) floor_pct,
round(100.0::DOUBLE * count(*) FILTER (verdict <> 'right') / count(*), 4) ceiling_pct, round(100.0::DOUBLE * count(*) FILTER (verdict = 'wrong') / nullif(count(*) FILTER (verdict <> 'unsure'), 0), 4) sure_pct FROM a GROUP BY ALL""")
def audit_rates_by_size(spark: SparkSession, sf: str) -> DataFrame:
    first = F.substring(F.sha2("key", 256), 1, 1)
    a = crops(spark, sf).select(F.floor(F.log2(F.least("w", "h"))).cast("int").alias("bin"), (F.col("species") % 3).alias("taxon"), F.when(first == "0", "wrong").when(first == "1", "unsure").otherwise("right").alias("v"))
    return profile.audit_rates(a, ["bin", "taxon"], "v")


@query("depth_histogram", "WITH e AS (SELECT x::INT bin, x * 100.0::DOUBLE low, x * 100.0::DOUBLE + 100 high FROM range(20) r(x)) SELECT bin, low, high, count(depth_m) n FROM e LEFT JOIN images ON depth_m >= low AND depth_m < high GROUP BY ALL")
def depth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.edge_histogram(table(spark, sf, "images"), "depth_m", [100.0 * x for x in range(21)])


@query("source_histograms", "SELECT source, 'camera' AS value, coalesce(camera, 'none') AS label, count(*) n FROM shard_records GROUP BY ALL UNION ALL SELECT source, 'crop_provenance', coalesce(crop_provenance, 'none'), count(*) FROM shard_records GROUP BY ALL UNION ALL SELECT source, 'build_no', coalesce(build_no::VARCHAR, 'none'), count(*) FROM shard_records GROUP BY ALL")
def source_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram_map(table(spark, sf, "shard_records"), "source", ["camera", "crop_provenance", "build_no"])


@query("names_by_crops", "WITH u AS (SELECT aphia_id, count(*) w FROM fishwio GROUP BY 1), e AS (SELECT 'genus' lvl, genus nm, aphia_id FROM worms_names WHERE genus IS NOT NULL UNION ALL SELECT 'family', family, aphia_id FROM worms_names WHERE family IS NOT NULL) SELECT lvl, nm, count(DISTINCT e.aphia_id) cats, coalesce(sum(w), 0)::BIGINT crops FROM e LEFT JOIN u ON u.aphia_id = e.aphia_id GROUP BY ALL")
def names_by_crops(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "fishwio").filter("aphia_id is not null").groupBy("aphia_id").agg(F.count("*").alias("w"))
    names = F.create_map(F.lit("genus"), F.col("genus"), F.lit("family"), F.col("family"))
    return profile.name_usage(table(spark, sf, "worms_names").join(uses, "aphia_id", "left"), "aphia_id", names, "w")


@query("gate_losses", f"""{WITH}, b AS (SELECT * FROM (VALUES (10), (20), (30)) c(min_crops), (VALUES (0), (2), (9)) g(min_groups)), p AS (SELECT species, count(*) n, count(DISTINCT deployment // 3) u, count(DISTINCT deployment) g, count(*) FILTER (survey <> 1) n2, count(DISTINCT deployment) FILTER (survey <> 1) g2 FROM crops GROUP BY species),
x AS (SELECT min_crops, min_groups, n >= min_crops AND g >= min_groups a, u >= min_crops AND g >= min_groups au, n2 >= min_crops AND g2 >= min_groups z FROM p, b) SELECT min_crops, min_groups, count(*) FILTER (a) passed, count(*) FILTER (au) passed_units, count(*) FILTER (a AND NOT z) lost, round(count(*) FILTER (a) / nullif(count(*) FILTER (au), 0), 6) inflation FROM x GROUP BY ALL""")
def gate_losses(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf).withColumn("unit", F.floor(F.col("deployment") / 3))
    return profile.gate_losses(c, c.filter("survey <> 1"), "species", "deployment", "unit", [10, 20, 30], [0, 2, 9])
