"""The shared business tables read as a labelled collection, for queries that SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

# a crop per line: species in genera in families in orders, deployments, sources, cameras, a box on a 1920 x 1080 frame
CROPS_SQL = """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT, round(l_extendedprice * 100)::BIGINT, l_shipdate::DATE) AS key,
    l_partkey AS species, l_partkey % 250 AS genus, l_partkey % 50 AS family, l_partkey % 10 AS ord, l_suppkey AS deployment, l_returnflag AS source, CASE l_linestatus WHEN 'F' THEN 'L' ELSE 'R' END AS camera, l_suppkey % 4 AS survey,
    (l_orderkey % 1800)::INT AS x, (l_partkey % 1000)::INT AS y, (8 + 10 * l_quantity)::INT AS w, (8 + 7 * l_quantity + l_linenumber)::INT AS h, l_quantity AS quantity FROM lineitem"""


def crops(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c("l_quantity").cast("int"), F.round(c("l_extendedprice") * 100).cast("long"), c("l_shipdate").cast("date")).alias("key"),
        c("l_partkey").alias("species"), (c("l_partkey") % 250).alias("genus"), (c("l_partkey") % 50).alias("family"), (c("l_partkey") % 10).alias("ord"), c("l_suppkey").alias("deployment"), c("l_returnflag").alias("source"),
        F.when(c("l_linestatus") == "F", "L").otherwise("R").alias("camera"), (c("l_suppkey") % 4).alias("survey"), (c("l_orderkey") % 1800).cast("int").alias("x"), (c("l_partkey") % 1000).cast("int").alias("y"),
        (8 + 10 * c("l_quantity")).cast("int").alias("w"), (8 + 7 * c("l_quantity") + c("l_linenumber")).cast("int").alias("h"), c("l_quantity").alias("quantity"),
    )


# frames of a video: hours since the epoch, videos by user, taxa by event type, boxes from the event number
SIGHTINGS_SQL = """SELECT event_id AS ident, user_id AS video, event_type AS taxon, (epoch_us(ts) // 3600000000)::BIGINT AS frame, (event_id * 7 % 40)::INT AS x, (event_id * 11 % 30)::INT AS y, (40 + event_id % 21)::INT AS w, (30 + event_id % 17)::INT AS h,
    CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END AS camera, value FROM events"""


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "events").select(
        c("event_id").alias("ident"), c("user_id").alias("video"), c("event_type").alias("taxon"), F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 3600).cast("long").alias("frame"),
        (c("event_id") * 7 % 40).cast("int").alias("x"), (c("event_id") * 11 % 30).cast("int").alias("y"), (40 + c("event_id") % 21).cast("int").alias("w"), (30 + c("event_id") % 17).cast("int").alias("h"),
        F.when(c("event_id") % 2 == 0, "L").otherwise("R").alias("camera"), "value",
    )


VECTORS_SQL = "SELECT vec_id, embedding, label, label // 2 AS genus, label // 4 AS family, vec_id % 20 AS deployment, vec_id % 4 AS source FROM embeddings"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label", F.floor(c("label") / 2).cast("int").alias("genus"), F.floor(c("label") / 4).cast("int").alias("family"), (c("vec_id") % 20).alias("deployment"), (c("vec_id") % 4).alias("source"))


# scored draws of candidates: one candidate per brand, level per flag, draw per line number
RESULTS_SQL = "SELECT l_returnflag AS level, 'c' || (l_partkey % 6) AS candidate, l_linenumber AS draw, l_suppkey % 3 AS geometry, avg(l_discount) AS recall FROM lineitem GROUP BY ALL"


def results(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "lineitem").select(c("l_returnflag").alias("level"), F.concat(F.lit("c"), c("l_partkey") % 6).alias("candidate"), c("l_linenumber").alias("draw"), (c("l_suppkey") % 3).alias("geometry"), "l_discount")
    return rows.groupBy("level", "candidate", "draw", "geometry").agg(F.avg("l_discount").alias("recall"))
