"""Plain joins of the document model's tables, with what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import lookup_join


def with_lineage(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """annotations with the columns of their category; those without one are left out."""
    return lookup_join(annotations, categories.dropDuplicates(["category_id"]), ["category_id"])


def with_license(images: DataFrame, datasets: DataFrame, licenses: DataFrame) -> DataFrame:
    """images (dataset_id) with dataset and license names, ``unknown`` where either is missing."""
    named = datasets.dropDuplicates(["dataset_id"]).join(licenses.dropDuplicates(["license_id"]), "license_id", "left").select("dataset_id", "dataset", "license")
    out = lookup_join(images, named, ["dataset_id"], "left")
    return out.withColumn("dataset", F.coalesce("dataset", F.lit("unknown"))).withColumn("license", F.coalesce("license", F.lit("unknown")))


def with_split(records: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """records with split; those without one are left out, the smallest counts where a key has several."""
    return records.join(splits.groupBy(key).agg(F.min("split").alias("split")), key)


def with_details(crops: DataFrame, details: DataFrame, on: list[str], reason: str, item: Column) -> tuple[DataFrame, DataFrame]:
    """(crops with the details' columns, review rows): a crop without details stays, and is reported as (item, reason)."""
    one = details.dropDuplicates(on).withColumn("_there", F.lit(True))
    both = lookup_join(crops, one, on, "left")
    return both.drop("_there"), both.filter("_there is null").select(item.cast("string").alias("item"), F.lit(reason).alias("reason"))


def crops_and_squares(crops: DataFrame, squares: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(crops joined with squares on key, side and key of what only one of them has)."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").select(F.lit(side).alias("side"), key)
    return crops.join(squares, key), only(crops, squares, "crops").unionByName(only(squares, crops, "squares"))


def concept_actions(annotations: DataFrame, concepts: DataFrame, concept: str) -> DataFrame:
    """annotations with action: class, unlabelled or drop; a concept that the map lacks is dropped, its rows stay to be counted."""
    known = concepts.groupBy(F.col("concept").alias(concept)).agg(F.min("action").alias("action"))
    return lookup_join(annotations, known, [concept], "left").withColumn("action", F.coalesce("action", F.lit("drop")))


def image_actions(annotations: DataFrame, image: str) -> DataFrame:
    """image, boxes, unlabelled, dropped, usable: an image with a dropped or unlabelled box is no background; usable says it has a class."""
    count = lambda a: F.count(F.when(F.col("action") == a, 1))
    return annotations.groupBy(image).agg(F.count("*").alias("boxes"), count("unlabelled").alias("unlabelled"), count("drop").alias("dropped"), (count("class") > 0).alias("usable"))
