"""The nested document model: one JSON object with six arrays."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_MAP = T.MapType(_S, _S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


INFO = _struct(("schema_version", _S), ("description", _S))
LICENSES = _struct(("id", _L), ("name", _S), ("url", _S), ("redistributable", _B))
DATASETS = _struct(("id", _L), ("name", _S), ("license_id", _L), ("continent", _S), ("countries", T.ArrayType(_S)), ("ocean_basins", T.ArrayType(_S)), ("habitat", _S))
CATEGORIES = _struct(("id", _L), ("name", _S), ("rank", _S), ("aphia_id", _L), ("lineage", _MAP), ("supercategory", _S), ("worms_status", _S))
IMAGES = _struct(
    ("id", _L), ("uid", _S), ("file_name", _S), ("width", _L), ("height", _L), ("dataset_id", _L), ("crop_provenance", _S), ("pixel_scale_known", _B), ("gear", _S), ("groups", _MAP), ("group_sources", _MAP),
    ("has_unlabelled_animal", _B), ("source_meta", _MAP), ("lat", _D), ("lon", _D), ("datetime", _S), ("depth_m", _D),
)
ANNOTATIONS = _struct(("id", _L), ("image_id", _L), ("category_id", _L), ("bbox", T.ArrayType(_D)), ("area", _D), ("iscrowd", _L), ("individual_id", _S), ("track_id", _S))
TABLES = {"licenses": LICENSES, "datasets": DATASETS, "categories": CATEGORIES, "images": IMAGES, "annotations": ANNOTATIONS}
DOCUMENT = T.StructType([T.StructField("info", INFO), *[T.StructField(n, T.ArrayType(t)) for n, t in TABLES.items()]])
# fixed values
PROVENANCES = ("frame", "pre_cropped", "cut_from_frame")
GROUP_LEVELS = ("deployment", "site", "survey", "region")
VERSIONS = ("1.1", "1.2")
