"""Queries: recall by level, cells, decisions, checks, metadata joins, frame diagnosis and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import keys as K
from tidemark.functions import stats
from tidemark.functions import taxa as X
from tidemark.operators import checks, decisions, evaluation, frames, metadata, profile, resolve, sampling, vectors
from tidemark.plans.core_b import DECIDE_SQL, DRAWS_SQL, PROTO_SQL, RES, embedded
from tidemark.plans.registry import query
from tidemark.plans.rehosted import CROPS_SQL, SIGHTINGS_SQL, crops, results, sightings
from tidemark.session import table

WITH = f"WITH crops AS ({CROPS_SQL})"
SEEN = f"WITH seen AS ({SIGHTINGS_SQL})"


def _level_sql(level: str, own: str, parent: str) -> str:
    answer = lambda mode, where: f"""SELECT '{level}' AS level, '{mode}' AS mode, round(avg(r), 6) macro_recall, count(*) n_classes, sum(n)::BIGINT n_queries FROM (SELECT {own.format('label')} t, avg(({own.format('predicted')} = {own.format('label')})::INT)::DOUBLE r, count(*) n
    FROM (SELECT vec_id, label, predicted FROM m {where} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, predicted) = 1) GROUP BY 1)"""  # noqa: E731
    kids = f"WHERE {parent.format('label')} = {parent.format('predicted')} AND {parent.format('label')} IN (SELECT {parent.format('label')} FROM p GROUP BY 1 HAVING count(DISTINCT {own.format('label')}) >= 2)"
    return answer("constrained", kids) + " UNION ALL " + answer("unconstrained", "")


@query("recall_by_level", PROTO_SQL + ", m AS (SELECT vec_id, u.label, p.label predicted, round(list_inner_product(e, p), 9) s FROM u JOIN p ON true WHERE vec_id % 2 = 1) " + " UNION ALL ".join([_level_sql("species", "{}", "({} // 2)"), _level_sql("genus", "({} // 2)", "({} // 4)"), _level_sql("family", "({} // 4)", "({} // 8)")]))
def recall_by_level(spark: SparkSession, sf: str) -> DataFrame:
    e = embedded(spark, sf)
    protos = vectors.prototypes(e.filter("vec_id % 2 = 0"), "label", "embedding")
    lineage = e.select("label", F.col("label").alias("species"), F.floor(F.col("label") / 2).alias("genus"), F.floor(F.col("label") / 4).alias("family"), F.floor(F.col("label") / 8).alias("ord")).distinct()
    return evaluation.recall_by_level(e.filter("vec_id % 2 = 1"), protos, lineage, "vec_id", "label", "embedding")


@query("candidate_recall", f"{WITH}, s AS (SELECT key, genus % 7 AS label, (deployment + genus) % 7 AS candidate, max(quantity) score FROM crops GROUP BY ALL UNION ALL SELECT key, genus % 7, (deployment * 3 + 1) % 7, max(h) FROM crops GROUP BY ALL), b AS (SELECT key, label, candidate FROM s WHERE label IN (0, 2, 3, 5) AND candidate IN (0, 2, 3, 5) QUALIFY row_number() OVER (PARTITION BY key, label ORDER BY score DESC, candidate) = 1) SELECT label, round(avg((candidate = label)::INT), 6) recall, count(*) n FROM b GROUP BY label")
def candidate_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf)
    label = (F.col("genus") % 7).alias("label")
    one = c.groupBy("key", label, ((F.col("deployment") + F.col("genus")) % 7).alias("candidate")).agg(F.max("quantity").cast("double").alias("score"))
    two = c.groupBy("key", label, ((F.col("deployment") * 3 + 1) % 7).alias("candidate")).agg(F.max("h").cast("double").alias("score"))
    few = spark.createDataFrame([(0,), (2,), (3,), (5,)], "candidate long")
    return evaluation.candidate_recall(one.unionByName(two), "key", "label", "candidate", "score", few)


@query("cell_candidates", f"""{WITH}, t AS (SELECT genus, count(*) n FROM crops GROUP BY genus), k AS (SELECT genus, max(v) k FROM t, (VALUES (1), (5), (20), (50), (100), (200)) x(v) WHERE n >= v GROUP BY genus)
SELECT 'per_k' AS rule, kk::INT AS k, genus FROM k, (VALUES (5), (50), (100)) y(kk) WHERE k >= kk UNION ALL SELECT 'fixed_k50', kk::INT, genus FROM k, (VALUES (5), (50), (100)) y(kk) WHERE k >= 50 AND kk <= 50 UNION ALL SELECT 'fixed_k100', kk::INT, genus FROM k, (VALUES (5), (50), (100)) y(kk) WHERE k >= 100 AND kk <= 100""")
def cell_candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = crops(spark, sf).groupBy("genus").agg(F.count("*").alias("n"))
    k = n.select("genus", F.array_max(F.filter(F.array(*[F.lit(x) for x in (1, 5, 20, 50, 100, 200)]), lambda x: F.col("n") >= x)).alias("most"))
    out = None
    for rule in ("per_k", "fixed_k50", "fixed_k100"):
        for bar in (5, 50, 100):
            own = evaluation.candidates(k, "genus", "most", bar, rule).select(F.lit(rule).alias("rule"), F.lit(bar).alias("k"), "genus")
            out = own if out is None else out.unionByName(own)
    return out


@query("scored_cells", f"""{WITH}, s AS (SELECT DISTINCT source s FROM crops), p AS (SELECT a.s a, b.s b FROM s a JOIN s b ON a.s < b.s), l AS (SELECT unnest(['species', 'genus', 'family']) AS level), d AS (SELECT a, b, a q, b r FROM p UNION ALL SELECT a, b, b, a FROM p),
x AS (SELECT * FROM d, l, (VALUES ('whole_taxon'), ('shared_children')) z(arm), (VALUES ('matched'), ('unmatched')) m(matching) WHERE arm = 'whole_taxon' OR a = 'A' AND level <> 'species'), v AS (SELECT *, 'main' AS variant FROM x UNION ALL SELECT *, 'without_low' FROM x WHERE arm = 'whole_taxon' AND matching = 'matched' AND b = 'R')
SELECT q || '<-' || r || '|' || level || '|' || arm || '|' || matching || '|' || variant AS cell, a || 'x' || b AS pair, q AS query_source, r AS reference_source, level, arm, matching, variant FROM v""")
def scored_cells(spark: SparkSession, sf: str) -> DataFrame:
    s = crops(spark, sf).select("source").distinct()
    pairs = s.select(F.col("source").alias("a")).join(s.select(F.col("source").alias("b")), F.col("a") < F.col("b"))  # a handful of sources
    variants = pairs.filter("b = 'R'").select("a", "b", F.lit("matched").alias("matching"), F.lit("without_low").alias("variant"))
    return evaluation.cells(pairs, ["species", "genus", "family"], pairs.filter("a = 'A'"), variants)


@query("shared_children", f"""{WITH}, c AS (SELECT key, source, genus, species FROM crops WHERE NOT (source = 'R' AND survey = 3) AND deployment % 5 = species % 5), b AS (SELECT genus, species FROM c WHERE source IN ('A', 'R') GROUP BY ALL HAVING count(DISTINCT source) = 2)
SELECT key, source, genus, species FROM c WHERE source IN ('A', 'R') AND (genus, species) IN (SELECT (genus, species) FROM b)""")
def shared_children(spark: SparkSession, sf: str) -> DataFrame:
    c = evaluation.without(crops(spark, sf), {"source": "R", "survey": 3}).filter("deployment % 5 = species % 5").select("key", "source", "genus", "species")
    return evaluation.shared_children(c, "source", "genus", "species", "A", "R")


@query("cell_taxa", f"{WITH}, c AS (SELECT * FROM crops WHERE deployment % 4 = species % 4) SELECT DISTINCT species FROM c WHERE source = 'A' AND species IN (SELECT species FROM c WHERE source = 'N')")
def cell_taxa(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.shared_taxa(crops(spark, sf).filter("deployment % 4 = species % 4"), "source", "species", "A", "N")


@query("stepped_draws")
def stepped_draws(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf)
    return evaluation.stepped_draws(c.filter("source = 'N'"), c.filter("source <> 'N'"), "genus", "deployment", "key", [5, 20, 50], 10, 2)


@query("readout_names", """WITH s AS (SELECT backbone AS store, max(layer::INT) % 5 + 1 n, count(cls) > 0 c FROM readouts GROUP BY backbone) SELECT store, unnest(CASE WHEN c THEN ['cls', 'patch_mean', 'patch_mean_normed', 'cls+patch_mean', 'cls+patch_mean_normed'] ELSE ['patch_mean', 'patch_mean_normed'] END) AS token, layer FROM (SELECT store, c, unnest(range(n))::VARCHAR AS layer FROM s)
UNION ALL SELECT store, unnest(['map', 'mean']), 'pooled' FROM s""")
def readout_names(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "readouts").groupBy(F.col("backbone").alias("store")).agg((F.max(F.col("layer").cast("int")) % 5 + 1).alias("n_layers"), (F.count("cls") > 0).alias("has_cls"))
    return evaluation.readouts(r.withColumn("pooled", F.array(F.lit("map"), F.lit("mean"))))


CASES_SQL = DECIDE_SQL + """, w AS (SELECT candidate w FROM z GROUP BY candidate ORDER BY round(avg(mean), 6) DESC, candidate LIMIT 1), sh AS (SELECT level, best FROM z, w WHERE candidate = w AND NOT tied), ba AS (SELECT candidate, string_agg(level, '+' ORDER BY level) best_at FROM (SELECT DISTINCT level, candidate FROM z WHERE candidate = best) GROUP BY candidate),
k AS (SELECT w candidate, 'winner' AS "role" FROM w UNION ALL SELECT best, 'best at ' || string_agg(level, '+' ORDER BY level) FROM sh, w WHERE best <> w GROUP BY best)"""


@query("decide_cases", CASES_SQL + " SELECT k.candidate, CASE WHEN (SELECT count(*) FROM sh) > 0 THEN 2 ELSE 1 END AS \"case\", \"role\", coalesce(best_at, 'none') best_at FROM k LEFT JOIN ba USING (candidate)")
def decide_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = results(spark, sf).groupBy("level", "candidate", "draw").agg(F.avg("recall").alias("v"))
    return decisions.decide_cases(decisions.decide(d, "level", "candidate", "draw", "v", stats.t_quantile(spark, 0.975, 6)), "level", "candidate")


@query("decision_stability", f"""{RES}, d AS (SELECT geometry, level, candidate, draw, avg(recall) v FROM r GROUP BY ALL), m AS (SELECT geometry, level, candidate, avg(v) m FROM d GROUP BY ALL), b AS (SELECT geometry, level, candidate best FROM m WHERE geometry <> 0 QUALIFY row_number() OVER (PARTITION BY geometry, level ORDER BY round(m, 9) DESC, candidate) = 1),
t AS (SELECT d.geometry, d.level, draw, v tv, best FROM d JOIN b ON b.level = d.level AND b.geometry = d.geometry AND d.candidate = best), s AS (SELECT d.geometry, d.level, d.candidate, best, avg(v) mean, avg(round(tv - v, 9)) md, stddev_samp(round(tv - v, 9)) sd, count(*) n FROM d JOIN t ON t.level = d.level AND t.draw = d.draw AND t.geometry = d.geometry GROUP BY ALL),
z AS (SELECT geometry, level, round(mean, 6) chosen_mean, best, NOT (CASE WHEN n < 2 THEN false WHEN coalesce(sd, 0) < 1e-12 THEN md > 1e-12 ELSE md / (sd / sqrt(n)) > 2.446911851144969 END) holds FROM s WHERE candidate = 'c1'),
a AS (SELECT x.geometry, x.level, x.m x, y.m y FROM m x JOIN m y ON y.geometry = 0 AND y.level = x.level AND y.candidate = x.candidate WHERE x.geometry <> 0), k AS (SELECT geometry, level, rank() OVER p + (count(*) OVER (PARTITION BY geometry, level, x) - 1) / 2 rx, rank() OVER q + (count(*) OVER (PARTITION BY geometry, level, y) - 1) / 2 ry FROM a WINDOW p AS (PARTITION BY geometry, level ORDER BY x), q AS (PARTITION BY geometry, level ORDER BY y)),
o AS (SELECT geometry, level, count(*) n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END rho FROM k GROUP BY ALL) SELECT z.geometry, z.level, holds, chosen_mean, best, coalesce(n, 0) n, rho FROM z LEFT JOIN o USING (geometry, level)""")
def decision_stability(spark: SparkSession, sf: str) -> DataFrame:
    d = results(spark, sf).groupBy("geometry", "level", "candidate", "draw").agg(F.avg("recall").alias("v"))
    return decisions.stability(d, "geometry", 0, "level", "candidate", "draw", "v", "c1", stats.t_quantile(spark, 0.975, 6))


SPEC_SQL = """s AS (SELECT DISTINCT 'b' || (l_partkey % 5) AS backbone, (l_partkey % 2 * 112 + 224)::INT AS size, 't' || (l_suppkey % 4) AS token, (l_suppkey % 3)::VARCHAR AS layer, 'g' || (l_linenumber % 3) AS geometry FROM lineitem WHERE l_quantity > 5), c AS (SELECT DISTINCT backbone, CASE backbone WHEN 'b1' THEN 336 WHEN 'b3' THEN 336 ELSE 224 END::INT AS size, token, layer FROM s WHERE backbone <> 'b4' AND token <> 't3'),
d AS (SELECT DISTINCT backbone, (CASE WHEN backbone = 'b2' THEN 224 ELSE size END)::INT AS size, token, layer FROM s WHERE token IN ('t1', 't3'))"""


def _spec(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf, "lineitem").filter("l_quantity > 5")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    s = line.select(F.concat(F.lit("b"), part % 5).alias("backbone"), (part % 2 * 112 + 224).cast("int").alias("size"), F.concat(F.lit("t"), supp % 4).alias("token"), (supp % 3).cast("string").alias("layer"), F.concat(F.lit("g"), F.col("l_linenumber") % 3).alias("geometry")).distinct()
    c = s.filter("backbone <> 'b4' and token <> 't3'").select("backbone", F.when(F.col("backbone").isin("b1", "b3"), 336).otherwise(224).alias("size"), "token", "layer").distinct()
    d = s.filter("token in ('t1', 't3')").select("backbone", F.when(F.col("backbone") == "b2", 224).otherwise(F.col("size")).cast("int").alias("size"), "token", "layer").distinct()
    return s, c, d


@query("check_spec", f"""WITH {SPEC_SQL}, g AS (SELECT DISTINCT backbone, 'g' || x AS geometry FROM c, range(3) r(x)), z AS (SELECT DISTINCT backbone, size zs FROM c)
SELECT 'unscored' AS problem, backbone, token, layer, geometry FROM c JOIN g USING (backbone) WHERE (backbone, token, layer, size, geometry) NOT IN (SELECT (backbone, token, layer, size, geometry) FROM s)
UNION SELECT 'other_size', backbone, token, layer, NULL FROM d JOIN z USING (backbone) WHERE size <> zs UNION SELECT 'not_kept', backbone, token, layer, NULL FROM d JOIN z USING (backbone) WHERE (backbone, token, layer) NOT IN (SELECT (backbone, token, layer) FROM c)
UNION SELECT 'beyond', backbone, token, layer, NULL FROM c WHERE (backbone, token, layer) NOT IN (SELECT (backbone, token, layer) FROM d) UNION SELECT 'dropped', backbone, token, layer, NULL FROM d WHERE backbone NOT IN (SELECT backbone FROM c)""")
def check_spec(spark: SparkSession, sf: str) -> DataFrame:
    s, c, d = _spec(spark, sf)
    due = c.select("backbone", F.explode(F.array(*[F.lit(f"g{x}") for x in range(3)])).alias("geometry")).distinct()
    return decisions.check_spec(c, s, d, due)


@query("kept_provenance", f"WITH {SPEC_SQL} SELECT backbone, size, token, layer, CASE WHEN (backbone, token, layer) IN (SELECT (backbone, token, layer) FROM d) THEN 'decision' ELSE 'stability re-plan' END AS why FROM c")
def kept_provenance(spark: SparkSession, sf: str) -> DataFrame:
    _, c, d = _spec(spark, sf)
    return decisions.kept_provenance(c, d)


SPLIT_SQL = """r AS (SELECT CASE WHEN length(crop_key) % 2 = 0 THEN 'crops' ELSE 'squares' END AS "set", crop_key AS key, lower(regexp_replace(source, '[^A-Za-z]', '', 'g')) AS source, grp, lower(trim(coalesce(split, ''))) AS before, heldout_genus IS NOT NULL AS heldout FROM split_crops WHERE crop_key IS NOT NULL),
l AS (SELECT *, CASE WHEN before IN ('dev', 'ungrouped') AND substr(key, 4, 1) <> '7' THEN before WHEN heldout AND substr(key, 5, 1) < 'e' THEN 'heldout' WHEN substr(grp, length(grp), 1) IN ('1', '4') THEN 'lock' ELSE 'train' END AS label FROM r)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "split_crops").filter("crop_key is not null")
    r = s.select(F.when(F.length("crop_key") % 2 == 0, "crops").otherwise("squares").alias("set"), F.col("crop_key").alias("key"), F.lower(F.regexp_replace("source", "[^A-Za-z]", "")).alias("source"), "grp", F.lower(F.trim(F.coalesce("split", F.lit("")))).alias("before"), F.col("heldout_genus").isNotNull().alias("heldout"))
    label = F.when(F.col("before").isin("dev", "ungrouped") & (F.substring("key", 4, 1) != "7"), F.col("before")).when(F.col("heldout") & (F.substring("key", 5, 1) < "e"), "heldout").when(F.substring(F.col("grp"), -1, 1).isin("1", "4"), "lock").otherwise("train")
    return r.withColumn("label", label)


@query("check_splits", f"""WITH {SPLIT_SQL}, n AS (SELECT coalesce(a.s, b.s) s FROM (SELECT "set" s, before l, count(*) n FROM l WHERE before IN ('dev', 'ungrouped') GROUP BY ALL) a FULL JOIN (SELECT "set" s, label l, count(*) n FROM l WHERE label IN ('dev', 'ungrouped') GROUP BY ALL) b ON a.s = b.s AND a.l = b.l WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)),
c AS (SELECT 'counts_unchanged' AS "check", (SELECT count(*) FROM n) failures UNION ALL SELECT 'groups_apart', count(*) FROM (SELECT source, grp FROM l WHERE grp <> '' GROUP BY ALL HAVING bool_or(label = 'train') AND bool_or(label = 'lock')) UNION ALL SELECT 'heldout_apart', count(*) FROM l WHERE "set" = 'crops' AND heldout AND label = 'train'
UNION ALL SELECT 'keys_agree', count(*) FROM (SELECT key FROM l WHERE "set" = 'crops' GROUP BY key HAVING count(DISTINCT label) > 1) UNION ALL SELECT 'main_sources_apart', count(*) FROM l WHERE source IN ('fishwio') AND label = 'train' UNION ALL SELECT 'keys_once', count(*) FROM (SELECT "set", key FROM l GROUP BY ALL HAVING count(*) > 1))
SELECT "check", failures, failures = 0 AS ok FROM c""")
def check_splits(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_splits(_labelled(spark, sf), ("fishwio",))


@query("check_partitions", f"""WITH {SPLIT_SQL}, s AS (SELECT key, grp, CASE WHEN label IN ('train', 'heldout') THEN 'pool' WHEN label = 'lock' THEN 'lock' END side, "set" s FROM l), h AS (SELECT grp, count(DISTINCT side) n, min(side) cs FROM s WHERE s = 'crops' AND side IS NOT NULL GROUP BY grp), o AS (SELECT s.*, n, cs FROM s LEFT JOIN h ON h.grp = s.grp WHERE s = 'squares' AND side IS NOT NULL)
SELECT 'known' AS "check", count(*) FILTER (cs IS NULL) failures, count(*) FILTER (cs IS NULL) = 0 ok FROM o UNION ALL SELECT 'same_side', count(*) FILTER (n > 1 OR cs <> side), count(*) FILTER (n > 1 OR cs <> side) = 0 FROM o""")
def check_partitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    return checks.check_partitions(rows.filter("`set` = 'crops'"), rows.filter("`set` = 'squares'"))


@query("off_fraction", f"{WITH}, g AS (SELECT survey, deployment, sha256('f:' || deployment) < '5' p FROM crops GROUP BY ALL) SELECT survey, count(*) \"groups\", count(*) FILTER (p) picked, round_even(count(*) * 0.3, 0)::BIGINT due FROM g GROUP BY survey HAVING count(*) FILTER (p) <> round_even(count(*) * 0.3, 0)")
def off_fraction(spark: SparkSession, sf: str) -> DataFrame:
    groups = crops(spark, sf).select("survey", "deployment").distinct()
    return checks.off_fraction(groups, "survey", F.sha2(F.concat(F.lit("f:"), F.col("deployment")), 256) < "5", 0.3)


def _usable_sql(where: str, bar: int) -> str:
    return f"(SELECT species, genus FROM (SELECT species, genus, deployment, count(*) n FROM u WHERE {where} GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= {bar + 3} AND sum(n) - max(n) >= 3)"


@query("lock_requirements", f"""{WITH}, u AS (SELECT source, species, genus, deployment, CASE WHEN deployment % 3 = 0 THEN 'lock' ELSE 'pool' END side, genus % 10 = 0 unseen FROM crops), v AS (
SELECT 'R1 species' AS requirement, count(*)::DOUBLE AS value, 10.0 low, NULL high FROM {_usable_sql("source = 'N' AND side = 'lock'", 5)} UNION ALL SELECT 'R1 genera', count(*), 5, NULL FROM (SELECT genus FROM {_usable_sql("source = 'N' AND side = 'lock'", 5)} GROUP BY genus HAVING count(*) >= 2) UNION ALL SELECT 'R1 species at more', count(*), 100, NULL FROM {_usable_sql("source = 'N' AND side = 'lock'", 9)}
UNION ALL SELECT 'R2 unseen', count(*), 4, NULL FROM {_usable_sql("source = 'N' AND unseen", 5)} UNION ALL SELECT 'R2 unseen elsewhere', count(*), 4, NULL FROM {_usable_sql("source = 'A'", 5)} WHERE species IN (SELECT species FROM {_usable_sql("source = 'N' AND unseen", 5)}) UNION ALL SELECT 'R3', count(*), 1000000, NULL FROM {_usable_sql("source = 'R' AND side = 'lock'", 5)}
UNION ALL SELECT 'R4', count(*), 19, NULL FROM u WHERE source = 'N' AND side <> 'lock' AND NOT unseen UNION ALL SELECT 'R5', round(avg((side = 'lock')::INT), 4), 0.2, 0.4 FROM u WHERE source = 'N') SELECT requirement, value, value >= low AND (high IS NULL OR value <= high) AS ok FROM v""")
def lock_requirements(spark: SparkSession, sf: str) -> DataFrame:
    u = crops(spark, sf).select("source", "species", "genus", F.col("deployment").alias("grp"), F.when(F.col("deployment") % 3 == 0, "lock").otherwise("pool").alias("side"), (F.col("genus") % 10 == 0).alias("unseen"))
    bars = {"sources": ("N", "A", "R"), "R1": (10, 5, 100), "R2": (4, 4), "R3": (1000000,), "R4": (19,), "R5": (0.2, 0.4)}
    return checks.lock_requirements(u, 5, 9, 3, bars)


MEMBER_SQL = """m AS (SELECT l_returnflag || '-' || (l_orderkey % 7) || '.tar' AS archive, l_returnflag AS source, (l_orderkey % 7)::INT AS idx, l_orderkey || '-' || l_linenumber AS key, unnest(CASE WHEN l_partkey % 50 = 0 THEN ['jpg'] ELSE ['jpg', 'json'] END) AS ext, l_quantity::BIGINT AS size, sha256(l_partkey::VARCHAR) AS digest FROM lineitem WHERE l_suppkey % 40 <> 1 AND NOT (l_returnflag = 'R' AND l_orderkey % 7 = 3)),
e AS (SELECT l_orderkey || '-' || l_linenumber AS key, CASE WHEN l_partkey % 90 = 1 THEN 'N' ELSE l_returnflag END AS source, (l_quantity + (l_partkey % 70 = 2)::INT)::BIGINT AS size, sha256((l_partkey + (l_partkey % 80 = 3)::INT)::VARCHAR) AS digest FROM lineitem WHERE l_suppkey % 30 <> 2)"""


@query("verify_shards", f"""WITH {MEMBER_SQL}, h AS (SELECT key, count(DISTINCT archive) a, min(source) s, min(size) sz, min(digest) dg FROM m WHERE ext = 'jpg' GROUP BY key), j AS (SELECT e.*, s, sz, dg FROM e JOIN h ON h.key = e.key), c AS (
SELECT 'pairs' AS "check", count(*) failures FROM (SELECT archive, key FROM m GROUP BY ALL HAVING count(*) FILTER (ext = 'jpg') <> 1 OR count(*) FILTER (ext = 'json') <> 1) UNION ALL SELECT 'numbered', count(*) FROM (SELECT source FROM m GROUP BY source HAVING min(idx) <> 0 OR max(idx) + 1 <> count(DISTINCT idx)) UNION ALL SELECT 'once', count(*) FROM h WHERE a > 1
UNION ALL SELECT 'missing', count(*) FROM e WHERE key NOT IN (SELECT key FROM h) UNION ALL SELECT 'extra', count(*) FROM h WHERE key NOT IN (SELECT key FROM e) UNION ALL SELECT 'placed', count(*) FROM j WHERE source <> s UNION ALL SELECT 'size', count(*) FROM j WHERE size <> sz UNION ALL SELECT 'digest', count(*) FROM j WHERE digest <> dg) SELECT "check", failures, failures = 0 AS ok FROM c""")
def verify_shards(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    part, key = F.col("l_partkey"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")
    built = line.filter("l_suppkey % 40 <> 1 and not (l_returnflag = 'R' and l_orderkey % 7 = 3)")
    ext = F.explode(F.when(part % 50 == 0, F.array(F.lit("jpg"))).otherwise(F.array(F.lit("jpg"), F.lit("json"))))
    members = built.select(F.concat("l_returnflag", F.lit("-"), F.col("l_orderkey") % 7, F.lit(".tar")).alias("archive"), F.col("l_returnflag").alias("source"), (F.col("l_orderkey") % 7).cast("int").alias("idx"), key, ext.alias("ext"), F.col("l_quantity").cast("long").alias("size"), F.sha2(part.cast("string"), 256).alias("digest"))
    due = line.filter("l_suppkey % 30 <> 2").select(key, F.when(part % 90 == 1, "N").otherwise(F.col("l_returnflag")).alias("source"), (F.col("l_quantity") + (part % 70 == 2).cast("int")).cast("long").alias("size"), F.sha2((part + (part % 80 == 3).cast("int")).cast("string"), 256).alias("digest"))
    return checks.verify_shards(due, members)


@query("verify_store", """WITH r AS (SELECT backbone AS store, row_number() OVER (PARTITION BY backbone ORDER BY readout_id, extracted_at) - 1 AS row, crop_key AS key, patch_mean v FROM readouts QUALIFY row_number() OVER (PARTITION BY readout_id ORDER BY extracted_at) = 1), e AS (SELECT DISTINCT backbone AS store, crop_key AS key FROM readouts WHERE length(crop_key) <> 11 OR crop_key > 'g'),
c AS (SELECT 'missing' AS "check", (SELECT count(*) FROM e WHERE (store, key) NOT IN (SELECT (store, key) FROM r WHERE key IS NOT NULL)) failures UNION ALL SELECT 'extra', (SELECT count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.store = r.store AND e.key = r.key)) UNION ALL SELECT 'once', (SELECT count(*) FROM (SELECT store, key FROM r GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'numbered', 0
UNION ALL SELECT 'dims', (SELECT count(*) FROM r WHERE coalesce(len(v), -1) <> 64) UNION ALL SELECT 'finite', (SELECT count(*) FROM r WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) UNION ALL SELECT 'nonzero', (SELECT count(*) FROM r WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR x <> 0 OR isnan(x))) = 0)) SELECT "check", failures::BIGINT AS failures, failures = 0 AS ok FROM c""")
def verify_store(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.ranks import placed

    r = checks.first_of(table(spark, sf, "readouts"), ["readout_id"], ["extracted_at"])
    rows = placed(r, ["backbone"], ["readout_id"], "row").select(F.col("backbone").alias("store"), (F.col("row") - 1).alias("row"), F.col("crop_key").alias("key"), F.col("patch_mean").alias("vector"))
    due = table(spark, sf, "readouts").filter("length(crop_key) <> 11 or crop_key > 'g'").select(F.col("backbone").alias("store"), F.col("crop_key").alias("key")).distinct()
    return checks.verify_store(due, rows, 64)


@query("verify_migration", """WITH a AS (SELECT o_orderkey AS i, o_custkey % 40 AS c FROM orders), m AS (SELECT x AS old, x // 2 AS new FROM range(40) r(x) WHERE x % 5 = 1 AND x // 2 <> x), b AS (SELECT i, CASE WHEN i % 900 = 7 THEN 3 ELSE coalesce(new, c) END AS c FROM a LEFT JOIN m ON old = c WHERE i % 1000 <> 3), k AS (SELECT x AS c FROM range(38) r(x) WHERE x NOT IN (SELECT old FROM m) OR x = 6 UNION ALL SELECT 4),
p AS (SELECT a.i, a.c, b.c now, new FROM a JOIN b ON a.i = b.i LEFT JOIN m ON old = a.c), z AS (SELECT 'images_kept' AS "check", 0 failures UNION ALL SELECT 'annotations_kept', (SELECT count(*) FROM a WHERE i NOT IN (SELECT i FROM b)) UNION ALL SELECT 'others_kept', (SELECT count(*) FROM p WHERE new IS NULL AND now <> c) UNION ALL SELECT 'moved', (SELECT count(*) FROM p WHERE now <> new)
UNION ALL SELECT 'known', (SELECT count(*) FROM b WHERE c NOT IN (SELECT c FROM k)) UNION ALL SELECT 'gone', (SELECT count(*) FROM k WHERE c IN (SELECT old FROM m)) UNION ALL SELECT 'once', (SELECT count(*) FROM (SELECT c FROM k GROUP BY c HAVING count(*) > 1))) SELECT "check", failures::BIGINT AS failures, failures = 0 AS ok FROM z""")
def verify_migration(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    before = o.select(F.col("o_orderkey").alias("annotation_id"), (F.col("o_custkey") % 40).alias("category_id"))
    x = spark.range(40).withColumnRenamed("id", "old")
    remap = x.filter("old % 5 = 1").select("old", F.floor(F.col("old") / 2).cast("long").alias("new")).filter("old <> new")
    moved = before.join(remap.withColumnRenamed("old", "category_id"), "category_id", "left").filter("annotation_id % 1000 <> 3").select("annotation_id", F.when(F.col("annotation_id") % 900 == 7, 3).otherwise(F.coalesce("new", "category_id")).cast("long").alias("category_id"))
    left = spark.range(38).withColumnRenamed("id", "category_id")
    left = left.join(remap.select(F.col("old").alias("category_id"), F.lit(True).alias("_m")), "category_id", "left").filter("_m is null or category_id = 6").select("category_id").unionByName(spark.createDataFrame([(4,)], "category_id long"))
    images = table(spark, sf, "images").select("image_id")
    return checks.verify_migration((images, images), (before, moved), (before.select("category_id").distinct(), left), remap)


@query("with_license", "WITH d AS (SELECT n_nationkey, n_name, CASE WHEN r_regionkey < 3 THEN r_name END l FROM nation LEFT JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 20) SELECT c_custkey AS image_id, coalesce(n_name, 'unknown') AS dataset, coalesce(l, 'unknown') AS license FROM customer LEFT JOIN d ON n_nationkey = c_nationkey")
def with_license(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_nationkey").alias("dataset_id"))
    datasets = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("dataset"), F.col("n_regionkey").alias("license_id"))
    licenses = table(spark, sf, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("license_id"), F.col("r_name").alias("license"))
    return metadata.with_license(images, datasets, licenses).select("image_id", "dataset", "license")


@query("with_lineage", "SELECT l_orderkey AS annotation_id, l_linenumber AS n, p_brand AS family, p_type AS genus FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10")
def with_lineage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("annotation_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("category_id"))
    categories = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("category_id"), F.col("p_brand").alias("family"), F.col("p_type").alias("genus"))
    return metadata.with_lineage(rows, categories).drop("category_id")


@query("details_review", "SELECT o_orderkey::VARCHAR AS item, 'no video' AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def details_review(spark: SparkSession, sf: str) -> DataFrame:
    crops_ = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("video"))
    videos = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("video"), F.col("c_mktsegment").alias("habitat"))
    return metadata.with_details(crops_, videos, ["video"], "no video", F.col("o_orderkey"))[1]


@query("crops_and_squares", "WITH a AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 = 0), b AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey % 5 = 0) SELECT 'crops' AS side, k AS key FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'squares', k FROM b WHERE k NOT IN (SELECT k FROM a)")
def crops_and_squares(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "key")
    return metadata.crops_and_squares(line.filter("l_returnflag = 'A' and l_suppkey % 3 = 0").select("key"), line.filter("l_returnflag = 'N' and l_suppkey % 5 = 0").select("key"), "key")[1]


@query("image_actions", "WITH m AS (SELECT p_partkey c, CASE WHEN p_size < 20 THEN 'class' WHEN p_size < 30 THEN 'unlabelled' ELSE 'drop' END a FROM part WHERE p_size <> 5), x AS (SELECT l_orderkey i, coalesce(a, 'drop') a FROM lineitem LEFT JOIN m ON c = l_partkey) SELECT i AS image, count(*) boxes, count(*) FILTER (a = 'unlabelled') unlabelled, count(*) FILTER (a = 'drop') dropped, bool_or(a = 'class') usable FROM x GROUP BY i")
def image_actions(spark: SparkSession, sf: str) -> DataFrame:
    concepts = table(spark, sf, "part").filter("p_size <> 5").select(F.col("p_partkey").alias("concept"), F.when(F.col("p_size") < 20, "class").when(F.col("p_size") < 30, "unlabelled").otherwise("drop").alias("action"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("c"))
    return metadata.image_actions(metadata.concept_actions(rows, concepts, "c"), "image")


NAMED_SQL = f"{SEEN}, s AS (SELECT ident, video v, camera c, frame f, video + (ident % 11 = 0)::INT rv, CASE WHEN ident % 7 = 0 THEN 'L' ELSE camera END rc, frame + (ident % 5 = 0)::INT * (ident % 3) rf, 'v' || video || camera || frame n FROM seen), n AS (SELECT *, CASE WHEN ident % 13 = 0 THEN NULL ELSE 'v' || rv || rc || rf END rn FROM s)"


@query("name_verdicts", NAMED_SQL + ", x AS (SELECT CASE WHEN coalesce(n, '') = '' OR coalesce(rn, '') = '' THEN 'no comparison' WHEN n = rn THEN 'agree' WHEN ident % 17 = 0 THEN 'unparsable' WHEN v <> rv THEN 'other video' WHEN c <> rc THEN 'other camera' ELSE 'other frame' END verdict, f - rf d FROM n) SELECT verdict, CASE WHEN verdict = 'other frame' THEN d END delta, count(*) n FROM x GROUP BY ALL")
def name_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    s, i = sightings(spark, sf), F.col("ident")
    rv, rc, rf = F.col("video") + (i % 11 == 0).cast("int"), F.when(i % 7 == 0, "L").otherwise(F.col("camera")), F.col("frame") + (i % 5 == 0).cast("int") * (i % 3)
    bad = i % 17 == 0
    rows = s.select(
        F.struct(F.when(~bad, F.col("video")).alias("video"), "camera", "frame").alias("stated"), F.struct(rv.alias("video"), rc.alias("camera"), rf.alias("frame")).alias("rebuilt"),
        F.concat(F.lit("v"), "video", "camera", "frame").alias("stated_name"), F.when(i % 13 != 0, F.concat(F.lit("v"), rv, rc, rf)).alias("rebuilt_name"),
    )
    return frames.name_verdicts(rows)


COVER_SQL = f"{SEEN}, need AS (SELECT video % 6 survey, video, camera, frame, 'v' || video || camera || frame || (CASE WHEN ident % 4 = 0 THEN '.avi' ELSE '.mp4' END) n FROM seen), have AS (SELECT video, camera, frame, 'v' || video || camera || frame || '.mp4' n FROM seen WHERE ident % 3 <> 0)"


def _cover(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = sightings(spark, sf)
    name = F.concat(F.lit("v"), "video", "camera", "frame")
    need = s.select((F.col("video") % 6).alias("survey"), "video", "camera", "frame", F.concat(name, F.when(F.col("ident") % 4 == 0, ".avi").otherwise(".mp4")).alias("name"))
    return need, s.filter("ident % 3 <> 0").select("video", F.lower("camera").alias("camera"), "frame", F.concat(name, F.lit(".mp4")).alias("name"))


@query("frame_coverage", COVER_SQL + " SELECT survey, count(DISTINCT n) needed, count(DISTINCT n) FILTER (n IN (SELECT n FROM have)) \"exact\", count(DISTINCT n) FILTER ((video, camera, frame) IN (SELECT (video, camera, frame) FROM have)) loose FROM need GROUP BY survey")
def frame_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return frames.coverage(*_cover(spark, sf), "survey")


@query("missing_frames", COVER_SQL + ", p AS (SELECT video, count(*) total, count(*) FILTER (n NOT IN (SELECT n FROM have)) missing FROM need GROUP BY video) SELECT video, total, missing, CASE WHEN missing = total THEN 'none' ELSE 'partial' END AS state FROM p WHERE missing > 0")
def missing_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames.missing_frames(*_cover(spark, sf), "video")


@query("offset_winners", f"{SEEN}, f AS (SELECT video v, CASE WHEN value > 8 THEN 1 ELSE 0 END delta, CASE WHEN value > 90 THEN 'R' ELSE 'L' END camera FROM seen WHERE value IS NOT NULL), a AS (SELECT min(delta) delta, min(camera) camera FROM f GROUP BY v HAVING count(DISTINCT (delta, camera)) = 1), k AS (SELECT delta, camera, count(*) c FROM a GROUP BY ALL) SELECT f.delta, f.camera, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) part, count(*) / sum(count(*)) OVER () >= 0.9 dominant, coalesce(any_value(c), 0) consistent FROM f LEFT JOIN k ON k.delta = f.delta AND k.camera = f.camera GROUP BY ALL")
def offset_winners(spark: SparkSession, sf: str) -> DataFrame:
    s = sightings(spark, sf).filter("value is not null")
    return frames.offset_winners(s.select("video", F.when(F.col("value") > 8, 1).otherwise(0).alias("delta"), F.when(F.col("value") > 90, "R").otherwise("L").alias("camera")), "video")


@query("file_states", "SELECT DISTINCT file_name AS name, CASE WHEN v IS NULL THEN 'absent' WHEN v THEN 'valid' ELSE 'invalid' END AS state FROM images LEFT JOIN (SELECT file_name f, bool_or(width > 900) v FROM images WHERE depth_m > 300 AND width IS NOT NULL GROUP BY 1) ON f = file_name WHERE file_name IS NOT NULL")
def file_states(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "images").filter("file_name is not null").withColumnRenamed("file_name", "name")
    return frames.file_states(i, i.filter("depth_m > 300 and width is not null").select("name", (F.col("width") > 900).alias("valid")))


@query("name_collisions", "SELECT substr(crop_key, 1, 5) AS stem, count(DISTINCT crop_key) AS \"names\" FROM split_crops WHERE crop_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT crop_key) > 1")
def name_collisions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "split_crops").filter("crop_key is not null").select("crop_key", F.substring("crop_key", 1, 5).alias("stem"))
    return frames.name_collisions(s, "crop_key", "stem")


@query("size_differences", "SELECT lower(source) AS survey, count(*) n, count(*) FILTER (native_width = width AND native_height = height) AS equal, round(avg(width - native_width), 6) mean_dw, round(avg(height - native_height), 6) mean_dh, round(avg(width / native_width), 6) mean_ratio FROM shard_records WHERE native_width > 0 AND native_height > 0 AND width > 0 AND height > 0 GROUP BY 1")
def size_differences(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "shard_records").select(F.lower("source").alias("survey"), F.col("native_width").alias("name_w"), F.col("native_height").alias("name_h"), F.col("width").alias("w"), F.col("height").alias("h"))
    return frames.size_differences(r, "survey")


@query("random_frames", f"{SEEN}, p AS (SELECT video, min(frame) lo, max(frame) hi FROM seen GROUP BY video) SELECT ident, s.video, (lo + floor(('0x' || substr(sha256('n:' || ident), 1, 8))::BIGINT / 4294967296.0 * (hi - lo + 1)))::BIGINT AS frame FROM seen s JOIN p ON p.video = s.video")
def random_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames.random_frames(sightings(spark, sf).select("ident", "video", "frame"), ["video"], "frame", "ident", "n")


@query("frame_keys", """SELECT uid, CASE WHEN crop_provenance = 'frame' THEN uid WHEN crop_provenance = 'cut_from_frame' THEN source || '-' || crop_key WHEN camera IS NOT NULL THEN source || '-' || deployment || '_' || upper(camera) || '_' || build_no END AS frame_key, regexp_extract('set-' || source || '-' || lpad(build_no::VARCHAR, 6, '0') || '.tar', '^set-(.*)-[^-]*\\.tar$', 1) AS shard_source
FROM shard_records WHERE uid IS NOT NULL AND source IS NOT NULL AND crop_provenance IS NOT NULL AND deployment IS NOT NULL""")
def frame_keys(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "shard_records").filter("uid is not null and source is not null and crop_provenance is not null and deployment is not null")
    c = F.col
    key = K.frame_key(c("crop_provenance"), c("source"), c("uid"), c("crop_key"), F.when(c("camera").isNotNull(), c("deployment")), c("camera"), c("build_no"))
    shard = K.shard_source(F.concat(F.lit("set-"), "source", F.lit("-"), F.lpad(c("build_no").cast("string"), 6, "0"), F.lit(".tar")), "set")
    return r.select("uid", key.alias("frame_key"), shard.alias("shard_source"))


@query("readout_keys", "SELECT DISTINCT '224|' || backbone || '|' || layer AS rid, 224 AS size, backbone AS token, layer FROM readouts WHERE backbone IS NOT NULL AND layer IS NOT NULL")
def readout_keys(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "readouts").filter("backbone is not null and layer is not null").select(K.readout_id(F.lit(224), F.col("backbone"), F.col("layer")).alias("rid")).distinct()
    return r.select("rid", K.readout_parts("rid").alias("p")).select("rid", "p.*")


@query("core_rank_gaps", """WITH t AS (SELECT map_id, lower(coalesce(taxon_rank, CASE WHEN map_id % 2 = 0 THEN 'Genus' ELSE 'Species' END)) "rank", [CASE WHEN map_id % 3 > 0 THEN 'x' END, CASE WHEN map_id % 5 > 0 THEN 'x' END, NULL, CASE WHEN map_id % 7 > 0 THEN ' ' END, family, genus, species] v, ['kingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species'] n FROM fishwio),
u AS (SELECT DISTINCT map_id, "rank", unnest(n) r, unnest(range(1, 8)) i, coalesce(trim(unnest(v)), '') <> '' there FROM t), f AS (SELECT *, coalesce(max(i) FILTER (there) OVER (PARTITION BY map_id, "rank", v), 0) finest FROM (SELECT u.*, 0 v FROM u)) SELECT r AS missing, count(*) n FROM f WHERE NOT there AND (i < finest OR r = "rank") GROUP BY r""")
def core_rank_gaps(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("map_id")
    rank = F.coalesce("taxon_rank", F.when(i % 2 == 0, "Genus").otherwise("Species"))
    lineage = F.create_map(F.lit("kingdom"), F.when(i % 3 > 0, "x"), F.lit("phylum"), F.when(i % 5 > 0, "x"), F.lit("order"), F.when(i % 7 > 0, " "), F.lit("family"), F.col("family"), F.lit("genus"), F.col("genus"), F.lit("species"), F.col("species"))
    rows = table(spark, sf, "fishwio").select("map_id", F.lower(rank).alias("rank"), "family", "genus", "species", lineage.alias("lineage"))
    gaps = rows.select("map_id", "rank", F.explode(X.lineage_gaps(F.col("lineage"), F.col("rank"))).alias("missing")).distinct()
    return gaps.groupBy("missing").agg(F.count("*").alias("n"))


@query("square_profile", f"""{WITH}, s AS (SELECT w, h, greatest(w, h) l, CASE WHEN species % 3 = 0 THEN 300 ELSE 1080 END f FROM crops), p AS (SELECT *, round_even(l * 1.1, 0)::INT g FROM s)
SELECT CASE WHEN l > f THEN 'padded' WHEN g > f THEN 'margin_reduced' ELSE 'fits' END AS tier, count(*) n, sum(CASE WHEN l > f THEN g ELSE least(g, f) END)::BIGINT side, round(sum(CASE WHEN l > f THEN round(greatest(0, 1 - f * f / (g * g)), 6) ELSE 0 END), 3) pad FROM p GROUP BY 1""")
def square_profile(spark: SparkSession, sf: str) -> DataFrame:
    short = F.when(F.col("species") % 3 == 0, 300).otherwise(1080)
    p = crops(spark, sf).select(G.square_profile(F.col("w"), F.col("h"), F.lit(1920), short, 0.1).alias("p")).select("p.*")
    return p.groupBy("tier").agg(F.count("*").alias("n"), F.sum("side").alias("side"), F.round(F.sum("pad_fraction"), 3).alias("pad"))


@query("input_sizes", f"{WITH} SELECT key, greatest(w, h) AS side, ((greatest(w, h) - w) // 2)::INT AS dx, ((greatest(w, h) - h) // 2)::INT AS dy FROM crops")
def input_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = crops(spark, sf).select("key", G.input_size(F.col("w"), F.col("h"), "letterbox").alias("p"))
    return p.select("key", F.col("p.w").alias("side"), "p.dx", "p.dy")


@query("blind_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('blind:' || doc_id), doc_id) AS index FROM (SELECT DISTINCT doc_id FROM documents)")
def blind_order(spark: SparkSession, sf: str) -> DataFrame:
    return checks.blind_order(table(spark, sf, "documents").select("doc_id").distinct(), "doc_id", "blind")


@query("sheet_scores", """WITH c AS (SELECT o_custkey AS sheet, list(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END ORDER BY o_orderkey) s FROM orders GROUP BY 1), p AS (SELECT c_custkey AS sheet, unnest(range(1, 11))::INT AS position FROM customer WHERE c_nationkey <> 3), x AS (SELECT sheet, unnest(range(1, len(s) + 1))::INT AS position, unnest(s) AS score FROM c),
j AS (SELECT coalesce(p.sheet, x.sheet) sheet, coalesce(p.position, x.position) position, score, p.sheet IS NOT NULL due FROM p FULL JOIN x ON x.sheet = p.sheet AND x.position = p.position) SELECT sheet, position, score, CASE WHEN NOT due AND score IS NOT NULL THEN 'not handed out' WHEN due AND score IS NULL THEN 'not scored' END AS problem FROM j WHERE due OR score IS NOT NULL""")
def sheet_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("sheet"), F.struct("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.substring("o_orderpriority", 1, 1)).alias("s")).alias("s"))
    cells = o.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]).alias("scores"))  # cells of one sheet
    pages = table(spark, sf, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("position"))
    return checks.sheet_scores(cells, pages)


@query("smallest_cover")
def smallest_cover(spark: SparkSession, sf: str) -> DataFrame:
    counts = crops(spark, sf).groupBy(F.col("deployment").alias("group"), F.col("genus").alias("taxon"), F.when(F.col("source") == "N", "a").otherwise("b").alias("stage")).agg(F.count("*").alias("units"))
    picked = resolve.staged_cover(counts, ["a", "b"], {"a": 4, "b": 3}, 12, [(3, 2)])
    return spark.createDataFrame([(i, s, int(g), float(x), int(u)) for i, (s, g, x, u) in enumerate(picked)], "step int, stage string, deployment long, gain double, usable long")


ADDRESS_SQL = """a AS (SELECT image_id i, (image_id % 5)::INT k, (2000 + image_id % 20)::VARCHAR || lpad((1 + image_id % 12)::VARCHAR, 2, '0') || '15' d, lpad((image_id % 9000)::VARCHAR, 4, '0') f, 'EX' || (1200 + image_id % 50) c FROM images)"""


@query("address_links", f"""WITH {ADDRESS_SQL} SELECT DISTINCT i AS image_id, CASE k WHEN 0 THEN 'MBARI:DocRicketts:D' || (f::INT) WHEN 1 THEN 'MBARI:i2MAP:DATE:' || d WHEN 2 THEN 'NOAA:' || c || ':D' || (i % 12) WHEN 3 THEN 'NOAA:' || c || ':DATE:' || d END AS token,
CASE k WHEN 1 THEN 'MBARI:i2MAP' WHEN 3 THEN 'NOAA:' || c END AS link_space, CASE k WHEN 0 THEN 'MBARI:DocRicketts' WHEN 2 THEN 'NOAA:' || c END AS dive_space, CASE WHEN k < 4 THEN d END AS day FROM a""")
def address_links(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.parsing import address_parts

    i = F.col("image_id")
    d = F.concat((2000 + i % 20).cast("string"), F.lpad((1 + i % 12).cast("string"), 2, "0"), F.lit("15"))
    folder, cruise = F.lpad((i % 9000).cast("string"), 4, "0"), F.concat(F.lit("EX"), 1200 + i % 50)
    paths = (
        F.concat(F.lit("/static/m3/framegrabs/Doc Ricketts/images/"), folder, F.lit("/cam_"), d, F.lit("T010203.png")), F.concat(F.lit("/static/m3/framegrabs/i2MAP/images/"), d, F.lit("/f.png")),
        F.concat(F.lit("/v/"), cruise, F.lit("_DIVE"), F.lpad((i % 12).cast("string"), 2, "0"), F.lit("/"), cruise, F.lit("_VID_"), d, F.lit(".png")), F.concat(F.lit("/v/"), cruise, F.lit("_VID_"), d, F.lit(".png")),
    )
    path = F.lit("/none.png")
    for k, p in enumerate(paths):
        path = F.when(i % 5 == k, p).otherwise(path)
    rows = table(spark, sf, "images").select("image_id", address_parts(F.when(i % 5 < 2, "MBARI").otherwise("NOAA Ocean Exploration"), path).alias("a"))
    return rows.select("image_id", F.element_at("a.tokens", 1).alias("token"), F.col("a.link.space").alias("link_space"), F.col("a.dive.space").alias("dive_space"), F.coalesce("a.link.day", "a.dive.day").alias("day")).distinct()


@query("testable_table", DRAWS_SQL + ", d AS (SELECT DISTINCT species, deployment, key FROM f WHERE draw = 0) SELECT d.species, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT d.key) n_crops, count(DISTINCT (source, d.deployment)) n_groups FROM d JOIN crops ON crops.key = d.key GROUP BY d.species")
def testable_table(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf)
    drawn = sampling.draws(c, "species", "deployment", "key", 20, 10, 1, 1000, "w")
    return profile.testable_table(drawn, "species", "deployment", "key", c, "source")


@query("shared_examples", f"""{WITH}, p AS (SELECT genus, count(*) FILTER (source = 'A') a, count(*) FILTER (source = 'R') b FROM crops GROUP BY genus), t AS (SELECT genus, row_number() OVER (ORDER BY least(a, b) DESC, genus) place FROM p WHERE least(a, b) >= 3 QUALIFY place <= 12),
r AS (SELECT place, c.genus, source, key, row_number() OVER (PARTITION BY c.genus, source ORDER BY key) rn, count(*) OVER (PARTITION BY c.genus, source) // 3 s FROM crops c JOIN t ON t.genus = c.genus WHERE source IN ('A', 'R')) SELECT place, genus, source, key FROM r WHERE (rn - 1) % s = 0 AND rn <= s * 3""")
def shared_examples(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shared_examples(crops(spark, sf), "genus", "source", "key", "A", "R", 12)


@query("concept_counts", f"{WITH}, c AS (SELECT genus, CASE WHEN survey = 2 THEN 'unknown' ELSE 's' || survey END i, deployment FROM crops) SELECT genus, i AS institution, count(*) boxes, count(DISTINCT deployment) records FROM c GROUP BY ROLLUP (genus, i) HAVING grouping(genus) = 0")
def concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = crops(spark, sf).select("genus", F.when(F.col("survey") != 2, F.concat(F.lit("s"), "survey")).alias("i"), "deployment")
    return profile.concept_counts(c, "genus", "i", "deployment")
