"""Record sets and shard layout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop_records(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """key, image_id, annotation_id: a row per box of a frame; one per image that is itself a crop (its first box by id, or none)."""
    frame = F.col("crop_provenance") == "frame"
    boxes = images.filter(frame).join(annotations.select("image_id", "annotation_id"), "image_id").select(F.concat(F.col("uid"), F.lit("-a"), F.col("annotation_id").cast("string")).alias("key"), "image_id", "annotation_id")
    first = annotations.groupBy("image_id").agg(F.min("annotation_id").alias("annotation_id"))
    whole = images.filter(~frame).join(first, "image_id", "left").select(F.col("uid").alias("key"), "image_id", "annotation_id")
    return boxes.unionByName(whole)


def greedy_shards(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """group, order, size, shard: a new shard starts when the current one already holds ``limit``.

    Where a shard ends depends on where it began, so a group is walked in order;
    the walk streams sorted batches (two numbers a row) and never holds a group.
    """
    kinds = dict(rows.dtypes)
    ordered = rows.select(group, order, size).repartition(group).sortWithinPartitions(group, order)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shard, held = object(), 0, 0
        for frame in frames:
            out = []
            for g, n in zip(frame[group], frame[size], strict=True):
                if g != current:
                    current, shard, held = g, 0, 0
                if held >= limit:
                    shard, held = shard + 1, 0
                held += 0 if n is None or n != n else int(n)
                out.append(shard)
            yield frame.assign(shard=out)

    return ordered.mapInPandas(walk, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, `{size}` {kinds[size]}, shard int")


def shard_manifest(shards: DataFrame, group: str, size: str) -> DataFrame:
    """group, shard, records, bytes."""
    return shards.groupBy(group, "shard").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))
