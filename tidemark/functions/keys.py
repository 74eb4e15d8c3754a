"""Keys that name frames, shards, groups and readouts, built and taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col

# fixed value: a background's frame key of the first source, ``source-<video>_<camera>_<frame>``
BACKGROUND = r"^ozfish-(.+)_([LR])_(\d+)$"


def shard_source(name: Column | str, prefix: str) -> Column:
    """The source of ``<prefix>-<source>-<number>.tar``; source names may hold hyphens."""
    stem = F.regexp_replace(F.regexp_replace(col(name), r"\.tar$", ""), f"^{prefix}-", "")
    return F.regexp_replace(stem, "-[^-]*$", "")


def shard_number(name: Column | str) -> Column:
    return F.regexp_extract(col(name), r"-(\d+)\.tar$", 1).try_cast("int")


def frame_key(provenance: Column, source: Column, uid: Column, image_uuid: Column, video: Column, camera: Column, frame: Column) -> Column:
    """The key of the frame that a record was cut from: its own uid, ``source-uuid``, or ``source-video_camera_frame``; null for none."""
    return (
        F.when(provenance == "frame", uid).when((provenance == "cut_from_frame") & image_uuid.isNotNull(), F.concat_ws("-", source, image_uuid))
        .when(video.isNotNull(), F.concat(source, F.lit("-"), F.concat_ws("_", video, F.upper(F.coalesce(camera, F.lit(""))), frame.cast("string"))))
    )


def background_group(source: Column, key: Column, by_image: Column, by_uid: Column) -> Column:
    """The group of a background: the video in its key, what is known of its image, or of its uid; empty for none."""
    return F.coalesce(F.when(source == "ozfish", F.regexp_extract(key, BACKGROUND, 1)).when(source == "fathomnet", by_image).otherwise(by_uid), F.lit(""))


def readout_id(size: Column, token: Column, layer: Column) -> Column:
    return F.concat_ws("|", size.cast("string"), token, layer.cast("string"))


def readout_parts(ident: Column | str) -> Column:
    """struct(size, token, layer) of a readout id."""
    p = F.split(col(ident), r"\|")
    return F.struct(F.try_element_at(p, F.lit(1)).try_cast("int").alias("size"), F.try_element_at(p, F.lit(2)).alias("token"), F.try_element_at(p, F.lit(3)).alias("layer"))
