"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compaction
from tidemark.plans import core_a, core_b, core_c, core_d  # noqa: F401  (they register their queries)
from tidemark.plans.registry import QUERIES, SQL, query  # noqa: F401
from tidemark.session import table


@query(
    "p1_found",
    r"""SELECT crop_key FROM (SELECT json_extract_string(o, '$.crop_key') AS crop_key FROM
(SELECT unnest(regexp_extract_all(payload, '\{[^{}]*\}')) AS o FROM raw_files) WHERE json_valid(o)) WHERE crop_key IS NOT NULL GROUP BY crop_key HAVING count(*) > 1""",
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.repeated(compaction.compact(spark, table(spark, sf, "raw_files")).files)


@query("p1_manifest")
def p1_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.compact(spark, table(spark, sf, "raw_files")).manifest


@query(
    "p1_totals",
    r"""WITH o AS (SELECT file_id, source fs, unnest(regexp_extract_all(payload, '\{[^{}]*\}')) AS o FROM raw_files), r AS (SELECT file_id, json_extract_string(o, '$.crop_key') k, nullif(regexp_replace(lower(json_extract_string(o, '$.source')), '[^a-z]', '', 'g'), '') s, nullif(regexp_replace(lower(fs), '[^a-z]', '', 'g'), '') fs FROM o WHERE json_valid(o)),
n AS (SELECT k, min_by(coalesce(s, fs, 'unknown'), file_id) s, count(*) n FROM r WHERE k IS NOT NULL GROUP BY k)
SELECT CASE s WHEN 'yolobruv' THEN 'yolo-bruv' ELSE s END AS source, count(*) records, sum(n)::BIGINT delivered FROM n GROUP BY ALL""",
)
def p1_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Records and deliveries per source, from the consolidated files."""
    files = compaction.compact(spark, table(spark, sf, "raw_files")).files
    return files.filter("crop_key is not null").groupBy("source").agg(F.count("*").alias("records"), F.sum("occurrences").alias("delivered"))
