"""Queries of the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import crop_sizes, garbled, leaks, matching, mixing, names, neighbours, sampling, splits
from tidemark.session import Scratch, table

SOURCE_SQL = "CASE regexp_replace(lower({0}), '[^a-z]', '', 'g') WHEN 'yolobruv' THEN 'yolo-bruv' WHEN '' THEN NULL ELSE regexp_replace(lower({0}), '[^a-z]', '', 'g') END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# 3. percentiles
SIDES_SQL = f"""
once AS (SELECT crop_key, any_value(campaign) campaign, any_value({SOURCE_SQL.format('source')}) source, any_value(build_no) build_no,
    any_value(CASE WHEN native_width > 0 AND native_height > 0 THEN least(native_width, native_height) END) shard_native,
    any_value(CASE WHEN bbox[3] > 0 AND bbox[4] > 0 THEN least(bbox[3], bbox[4]) END) ann_bbox FROM shard_records GROUP BY crop_key),
sides AS (SELECT campaign, source, build_no, 'shard_native' definition, shard_native::DOUBLE side FROM once WHERE shard_native IS NOT NULL
    UNION ALL SELECT campaign, source, build_no, 'ann_bbox', ann_bbox::DOUBLE FROM once WHERE ann_bbox IS NOT NULL)"""


@query(
    "p3_found",
    f"""WITH {SIDES_SQL},
stated AS (SELECT DISTINCT campaign, build_no, {SOURCE_SQL.format('source')} source, definition, p10, median, p90 FROM crop_sizes_shards),
got AS (SELECT s.campaign, s.build_no, s.source, s.definition, s.p10, s.median, s.p90, quantile_cont(side, 0.1) a, quantile_cont(side, 0.5) b, quantile_cont(side, 0.9) c
    FROM stated s JOIN sides d ON d.campaign = s.campaign AND d.source = s.source AND d.definition = s.definition AND d.build_no <= s.build_no GROUP BY ALL)
SELECT DISTINCT campaign, build_no, source, definition FROM got WHERE abs(p10 - a) > 0.2 * a OR abs(median - b) > 0.2 * b OR abs(p90 - c) > 0.2 * c""",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return crop_sizes.wrong_sizes(spark, table(spark, sf, "shard_records"), table(spark, sf, "crop_sizes_shards"))


@query(
    "p3_percentiles",
    f"""WITH {SIDES_SQL}, g AS (SELECT DISTINCT campaign, source, definition, build_no FROM sides)
SELECT g.campaign, g.source, g.definition, g.build_no, count(*) n, quantile_disc(side, 0.1) p10, quantile_disc(side, 0.5) median, quantile_disc(side, 0.9) p90
FROM g JOIN sides d ON d.campaign = g.campaign AND d.source = g.source AND d.definition = g.definition AND d.build_no <= g.build_no GROUP BY ALL""",
)
def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    builds = crop_sizes.sketches_per_build(spark, table(spark, sf, "shard_records"))
    return crop_sizes.up_to_build(builds, builds).select("campaign", "source", "definition", "build_no", "n", "p10", "median", "p90")


@query(
    "p3_rank_error",
    f"""WITH {SIDES_SQL}, g AS (SELECT DISTINCT campaign, source, definition, build_no FROM sides)
SELECT g.campaign, g.source, g.definition, g.build_no, count(*) n, true p10, true median, true p90 FROM g JOIN sides d ON d.campaign = g.campaign AND d.source = g.source AND d.definition = g.definition AND d.build_no <= g.build_no GROUP BY ALL""",
)
def p3_rank_error(spark: SparkSession, sf: str) -> DataFrame:
    """Whether merged sketches of k = 64, which nearly all compact, keep to their rank error."""
    return crop_sizes.rank_errors(spark, table(spark, sf, "shard_records"), 64)


# 6. groups of matches
URL_SQL = "concat(lower(regexp_extract({0}, '^([^/]*)', 1)), regexp_extract({0}, '^[^/]*(.*)$', 1))"
BARE_SQL = "url_decode(replace(regexp_replace(trim({0}, ' \t\n\r'), '^https?://', '', 'i'), '+', '%2B'))"


def _url(c: str) -> str:
    return URL_SQL.format(BARE_SQL.format(c))


@query(
    "p6_found",
    f"""WITH RECURSIVE l AS (SELECT DISTINCT {_url('frame_url_a')} a, {_url('frame_url_b')} b FROM frame_matches WHERE frame_url_a IS NOT NULL AND frame_url_b IS NOT NULL),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
i AS (SELECT DISTINCT image_id, {_url('frame_url')} u FROM images),
r AS (SELECT image_id s, u FROM i WHERE u IN (SELECT a FROM e) UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.u),
g AS (SELECT i.image_id, min(r.s) group_id FROM i JOIN r ON r.u = i.u GROUP BY i.image_id)
SELECT image_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY group_id HAVING count(*) > 1)""",
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return matching.image_groups(spark, table(spark, sf, "images"), table(spark, sf, "frame_matches"))


# 4. splits
PLACE_SQL = r"replace(regexp_replace(trim(regexp_replace(concat(' ', regexp_replace(lower(trim({0})), '[^a-z0-9]+', ' ', 'g')), '([^0-9])0+([0-9])', '\1\2', 'g')), '([0-9]) ([0-9])', '\1_\2', 'g'), ' ', '')"


@query(
    "p4_found",
    f"""WITH named AS (SELECT DISTINCT source, deployment, coalesce(derived_level = 'cruise', false) cruise FROM fn_dev_groups UNION SELECT source, deployment, false FROM dev_deployments),
listed AS (SELECT source, deployment, cruise, {PLACE_SQL.format('deployment')} k FROM named),
crops AS (SELECT DISTINCT {SOURCE_SQL.format('source')} source, {PLACE_SQL.format('grp')} k, {PLACE_SQL.format("regexp_extract(trim(grp), '^([^:/|]*[:/|][^:/|]*)[:/|]', 1)")} head, lower(trim(split, ' \t\n')) split FROM split_crops),
placed AS (SELECT source, k, head, split FROM crops WHERE k <> '' AND split IN ('train', 'dev', 'lock')),
owned AS (SELECT coalesce(c.source, l.source) source, coalesce(c.deployment, l.deployment) deployment, p.split FROM placed p LEFT JOIN listed l ON l.source = p.source AND l.k = p.k
    LEFT JOIN listed c ON c.cruise AND c.source = p.source AND c.k = p.head)
SELECT source, deployment FROM owned WHERE deployment IS NOT NULL GROUP BY source, deployment HAVING count(DISTINCT split) > 1""",
)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.conflicting(spark, table(spark, sf, "split_crops"), table(spark, sf, "dev_deployments"), table(spark, sf, "fn_dev_groups"))


@query("p4_assign")
def p4_assign(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign(spark, table(spark, sf, "split_crops"), table(spark, sf, "dev_deployments"), table(spark, sf, "fn_dev_groups"))


@query(
    "p4_components",
    f"""WITH named AS (SELECT DISTINCT source, deployment FROM fn_dev_groups WHERE derived_level = 'cruise'), cruises AS (SELECT DISTINCT source, {PLACE_SQL.format('deployment')} k FROM named),
crops AS (SELECT {SOURCE_SQL.format('source')} source, {PLACE_SQL.format('grp')} k, {PLACE_SQL.format("regexp_extract(trim(grp), '^([^:/|]*[:/|][^:/|]*)[:/|]', 1)")} head, lower(trim(split, ' \t\n')) split, count(*) n FROM split_crops GROUP BY ALL),
e AS (SELECT p.source || '|' || p.k entity, coalesce(c.source || '|' || c.k, p.source || '|' || p.k) own, CASE WHEN split IN ('train', 'dev', 'lock') THEN split END split, n FROM crops p LEFT JOIN cruises c ON c.source = p.source AND c.k = p.head WHERE p.k <> '' AND p.source IS NOT NULL),
x AS (FROM e UNION ALL SELECT own, own, NULL, 0 FROM e), w AS (SELECT own, entity, sum(n) weight FROM x GROUP BY ALL), j AS (SELECT own, min(entity) component, count(DISTINCT split) c, any_value(split) split FROM x GROUP BY own)
SELECT entity, component, CASE WHEN c = 1 THEN split END AS split, CASE WHEN c > 1 THEN 'quarantined' WHEN c = 1 THEN 'kept' ELSE 'new' END AS status, weight::BIGINT AS weight FROM w JOIN j USING (own)""",
)
def p4_components(spark: SparkSession, sf: str) -> DataFrame:
    """The kept component table after two runs, before new components get a split."""
    listed = Scratch(spark, "deployments").save(splits.deployments_table(table(spark, sf, "dev_deployments"), table(spark, sf, "fn_dev_groups")), "listed")
    return splits.in_two_runs(spark, table(spark, sf, "split_crops"), listed)


# 7. samples
NAME_SQL = r"replace(regexp_replace(lower(trim({0}, ' \t\n')), '\.(jpe?g|png)$', ''), '_', '-')"


@query(
    "p7_found",
    f"""WITH s AS (SELECT DISTINCT seed, run_no, {NAME_SQL.format('crop_key')} k FROM lock_selection),
runs AS (SELECT DISTINCT seed, run_no FROM s), keys AS (SELECT DISTINCT crop_key FROM split_crops)
SELECT DISTINCT a.seed, c.crop_key FROM s a JOIN keys c ON {NAME_SQL.format('c.crop_key')} = a.k JOIN runs r ON r.seed = a.seed AND r.run_no > a.run_no
WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.seed = a.seed AND b.run_no = r.run_no AND b.k = a.k)""",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.lost(spark, table(spark, sf, "lock_selection"), table(spark, sf, "split_crops"))


@query(
    "p7_sample",
    f"""WITH keys AS (SELECT {NAME_SQL.format('crop_key')} k, min(crop_key) crop_key FROM split_crops GROUP BY 1), n AS (SELECT count(*) n FROM keys), f AS (SELECT seed, max_by(frac, run_no) frac FROM lock_selection GROUP BY seed),
kept AS (SELECT DISTINCT s.seed, keys.crop_key FROM lock_selection s JOIN keys ON keys.k = {NAME_SQL.format('s.crop_key')}),
q AS (SELECT f.seed, greatest(0, round_even(frac * n, 0) - (SELECT count(*) FROM kept WHERE kept.seed = f.seed)) q FROM f, n),
u AS (SELECT f.seed, keys.crop_key, row_number() OVER (PARTITION BY f.seed ORDER BY substr(sha256(f.seed || ':' || keys.crop_key), 1, 15), keys.crop_key) rn FROM f JOIN keys ON NOT EXISTS (SELECT 1 FROM kept WHERE kept.seed = f.seed AND kept.crop_key = keys.crop_key))
SELECT seed, crop_key, true kept FROM kept UNION ALL SELECT u.seed, u.crop_key, false FROM u JOIN q ON q.seed = u.seed WHERE rn <= q""",
)
def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.current_sample(spark, table(spark, sf, "lock_selection"), table(spark, sf, "split_crops"))


@query(
    "p7_two_runs",
    f"""WITH keys AS (SELECT {NAME_SQL.format('crop_key')} k, min(crop_key) crop_key, min(added_at) added_at FROM split_crops GROUP BY 1), f AS (SELECT seed, max_by(frac, run_no) frac FROM lock_selection GROUP BY seed), t AS (SELECT min(drawn_at) t FROM lock_selection),
a AS (SELECT f.seed, frac, keys.crop_key, substr(sha256(f.seed || ':' || keys.crop_key), 1, 15) h, coalesce(added_at <= t.t, true) early FROM f, keys, t),
one AS (SELECT seed, crop_key FROM a WHERE early QUALIFY row_number() OVER (PARTITION BY seed ORDER BY h, crop_key) <= round_even(frac * count(*) OVER (PARTITION BY seed), 0)),
u AS (SELECT a.*, one.seed IS NOT NULL was FROM a LEFT JOIN one ON one.seed = a.seed AND one.crop_key = a.crop_key),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, was ORDER BY h, crop_key) rn, count(*) OVER (PARTITION BY seed) n, count(*) FILTER (was) OVER (PARTITION BY seed) c FROM u)
SELECT seed, 1 run_no, crop_key FROM one UNION ALL SELECT seed, 2, crop_key FROM r WHERE NOT was AND rn <= round_even(frac * n, 0) - c""",
)
def p7_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.in_two_runs(spark, table(spark, sf, "lock_selection"), table(spark, sf, "split_crops"))


# 2. typed names
@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.map_names(spark, table(spark, sf, "fishwio"), table(spark, sf, "worms_names")).select("map_id", "aphia_id")


@query("p2_report")
def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return names.map_names(spark, table(spark, sf, "fishwio"), table(spark, sf, "worms_names"))


# 5. similar vectors
UNIT_SQL = "list_transform({0}, lambda y: y::DOUBLE / sqrt(list_sum(list_transform({0}, lambda z: z::DOUBLE * z::DOUBLE))))"
FINITE_SQL = "({0} IS NOT NULL AND len(list_filter({0}, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND list_sum(list_transform({0}, lambda z: abs(z::DOUBLE))) > 0)"
NEAR_SQL = f"""WITH r AS (SELECT DISTINCT ON (readout_id) * FROM readouts),
u AS (SELECT readout_id id, backbone, layer, {UNIT_SQL.format('patch_mean')} v FROM r WHERE backbone = 'murk-so400' AND {FINITE_SQL.format('patch_mean')}
    UNION ALL SELECT readout_id, backbone, layer, list_concat({UNIT_SQL.format('cls')}, {UNIT_SQL.format('patch_mean')}) FROM r WHERE backbone <> 'murk-so400' AND {FINITE_SQL.format('cls')} AND {FINITE_SQL.format('patch_mean')}),
p AS (SELECT a.id a, b.id b, list_cosine_similarity(a.v, b.v) s FROM u a JOIN u b ON a.backbone = b.backbone AND a.layer = b.layer AND a.id <> b.id),
t AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) rn FROM p QUALIFY rn <= 5)"""


@query("p5_found", NEAR_SQL + " SELECT x.a readout_id_a, x.b readout_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.s >= 0.9")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.close_pairs(spark, table(spark, sf, "readouts"))


def _neighbours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    readouts = table(spark, sf, "readouts")
    units = Scratch(spark, "units").save(neighbours.unit_vectors(readouts), "units")
    asked = readouts.filter("readout_id % 50 = 0").select(F.col("readout_id").alias("id")).distinct()
    return units, asked, neighbours.similar(spark, units, queries=asked, probes=None, beam=neighbours.WIDE_BEAM, shard=neighbours.WIDE_SHARD)


@query("p5_neighbours")
def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every readout whose id is divisible by 50, against all shards."""
    return _neighbours(spark, sf)[2]


@query("p5_recall")
def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of p5_neighbours by group, against brute force over all readouts."""
    units, asked, found = _neighbours(spark, sf)
    return neighbours.recall(spark, units, Scratch(spark, "found").save(found, "found"), asked)


# 8. leaked evaluation texts
@query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(spark, table(spark, sf, "documents"), table(spark, sf, "eval_items")).filter("kind = 'repeated'").select("doc_id", "item_id")


@query("p8_report")
def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(spark, table(spark, sf, "documents"), table(spark, sf, "eval_items"))


# 10. wrong encodings
@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.restore(spark, table(spark, sf, "documents")).select("doc_id").distinct()


@query("p10_restored")
def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.restore(spark, table(spark, sf, "documents"))


# 9. mixing
@query("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    mixed = mixing.mix(spark, table(spark, sf, "documents"), targets)
    return mixing.actual_shares(Scratch(spark, "mixed").save(mixed.drop("tokens"), "mixed"), targets)
