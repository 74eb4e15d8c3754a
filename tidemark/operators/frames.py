"""Diagnosing which frames a collection needs, has, and names differently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE_NAME = r"(?i)\.(png|jpe?g|tiff?|bmp)$"


def name_verdicts(rows: DataFrame) -> DataFrame:
    """verdict, delta, n of pairs of frame names as structs (video, camera, frame): ``stated`` and ``rebuilt``, with their names.

    The first verdict that fits: no comparison, agree, unparsable, other video,
    other camera, other frame; delta (stated minus rebuilt frame) only for the last.
    """
    s, r = F.col("stated"), F.col("rebuilt")
    delta = s["frame"] - r["frame"]
    verdict = (
        F.when(F.coalesce("stated_name", F.lit("")).eqNullSafe("") | F.coalesce("rebuilt_name", F.lit("")).eqNullSafe(""), "no comparison").when(F.col("stated_name") == F.col("rebuilt_name"), "agree")
        .when(s["video"].isNull() | r["video"].isNull(), "unparsable").when(s["video"] != r["video"], "other video").when(F.upper(s["camera"]) != F.upper(r["camera"]), "other camera").otherwise("other frame")
    )
    return rows.select(verdict.alias("verdict"), F.when(verdict == "other frame", delta).alias("delta")).groupBy("verdict", "delta").agg(F.count("*").alias("n"))


def coverage(needed: DataFrame, held: DataFrame, survey: str) -> DataFrame:
    """survey, needed, exact, loose: distinct frame names needed, held by name, and held by (video, camera, frame).

    needed: (survey, name, video, camera, frame); held: (name, video, camera, frame).
    """
    names = held.select("name", F.lit(True).alias("_e")).distinct()
    loose = held.select("video", F.upper("camera").alias("camera"), "frame", F.lit(True).alias("_l")).distinct()
    both = needed.withColumn("camera", F.upper("camera")).join(names, "name", "left").join(loose, ["video", "camera", "frame"], "left")
    return both.groupBy(survey).agg(F.count_distinct("name").alias("needed"), F.count_distinct(F.when(F.col("_e"), F.col("name"))).alias("exact"), F.count_distinct(F.when(F.col("_l"), F.col("name"))).alias("loose"))


def missing_frames(needed: DataFrame, held: DataFrame, deployment: str) -> DataFrame:
    """deployment, total, missing, state: none (no frame is held) or partial; whole deployments are left out."""
    both = needed.join(held.select("name", F.lit(True).alias("_e")).distinct(), "name", "left")
    per = both.groupBy(deployment).agg(F.count("*").alias("total"), F.count(F.when(F.col("_e").isNull(), 1)).alias("missing"))
    return per.filter("missing > 0").withColumn("state", F.when(F.col("missing") == F.col("total"), "none").otherwise("partial"))


def offset_winners(found: DataFrame, deployment: str, share: float = 0.9) -> DataFrame:
    """delta, camera, n, part, dominant, consistent of the offsets found (deployment, delta, camera).

    dominant: the offset makes up ``share`` of all; consistent: the number of
    deployments that know no other offset.
    """
    alone = found.groupBy(deployment).agg(F.count_distinct("delta", "camera").alias("k"), F.min(F.struct("delta", "camera")).alias("o")).filter("k = 1").groupBy("o").agg(F.count("*").alias("consistent")).select("o.*", "consistent")
    whole = found.agg(F.count("*").alias("_all"))
    per = found.groupBy("delta", "camera").agg(F.count("*").alias("n")).join(F.broadcast(whole)).join(alone, ["delta", "camera"], "left")  # one row for all
    part = F.col("n") / F.col("_all")
    return per.select("delta", "camera", "n", F.round(part, 6).alias("part"), (part >= share).alias("dominant"), F.coalesce("consistent", F.lit(0)).alias("consistent"))


def name_column(rows: DataFrame, columns: list[str], look_at: int = 500) -> str | None:
    """The column with the most image-like values in the first ``look_at`` rows (the feature: a look at the head); none where no value is."""
    head = rows.limit(look_at)
    counts = head.agg(*[F.count(F.when(F.col(c).cast("string").rlike(IMAGE_NAME), 1)).alias(c) for c in columns]).head().asDict()
    best = max(columns, key=lambda c: (counts[c], -columns.index(c)), default=None)
    return best if best is not None and counts[best] else None


def file_states(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """name, state: valid, invalid or absent of the wanted files; what is not valid is left to do."""
    have = files.groupBy("name").agg(F.bool_or("valid").alias("_v"))
    return wanted.select("name").distinct().join(have, "name", "left").select("name", F.when(F.col("_v").isNull(), "absent").when(F.col("_v"), "valid").otherwise("invalid").alias("state"))


def name_collisions(rows: DataFrame, name: str, stem: str) -> DataFrame:
    """stem, names: stems that several different names share."""
    return rows.groupBy(stem).agg(F.count_distinct(name).alias("names")).filter("names > 1")


def size_differences(rows: DataFrame, survey: str) -> DataFrame:
    """survey, n, equal, mean_dw, mean_dh, mean_ratio of the size that a file name states (name_w, name_h) and that of its pixels (w, h)."""
    both = rows.filter("name_w > 0 and name_h > 0 and w > 0 and h > 0")
    return both.groupBy(survey).agg(
        F.count("*").alias("n"), F.count(F.when((F.col("name_w") == F.col("w")) & (F.col("name_h") == F.col("h")), 1)).alias("equal"), F.round(F.avg(F.col("w") - F.col("name_w")), 6).alias("mean_dw"), F.round(F.avg(F.col("h") - F.col("name_h")), 6).alias("mean_dh"),
        F.round(F.avg(F.col("w") / F.col("name_w")), 6).alias("mean_ratio"),
    )


def random_frames(rows: DataFrame, keys: list[str], frame: str, ident: str, seed: str) -> DataFrame:
    """rows with their frame replaced by a reproducible random one within the span of their key (a null model)."""
    from tidemark.functions.text import hash_order

    span = rows.groupBy(*keys).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))
    u = F.conv(F.substring(hash_order(F.lit(seed), F.col(ident)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.join(span, keys).withColumn(frame, (F.col("_lo") + F.floor(u * (F.col("_hi") - F.col("_lo") + 1))).cast(dict(rows.dtypes)[frame])).select(*rows.columns)
