"""Readers of the inputs of a collation, and its writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.operators.ranks import placed


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one or many documents; a table that a document lacks is empty.

    The schema is given, so nothing is inferred and unused columns of an array
    are pruned by the JSON reader.
    """
    whole = spark.read.schema(S.DOCUMENT).option("multiLine", True).json(path)
    return {name: whole.select(F.inline(name)) for name in S.TABLES} | {"info": whole.select("info.*")}


def problems(tables: dict[str, DataFrame]) -> DataFrame:
    """check, key: every violation of the document model (ids, enums, sizes, references, group sources)."""
    images, annotations, categories, datasets, licenses = (tables[x] for x in ("images", "annotations", "categories", "datasets", "licenses"))

    def found(check: str, df: DataFrame, key: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))

    out = [found(f"duplicate {name} id", t.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "id") for name, t in tables.items() if name != "info"]
    out.append(found("duplicate file name", images.groupBy(F.lower(F.trim("file_name")).alias("f")).agg(F.count("*").alias("n")).filter("n > 1"), "f"))
    out.append(found("image provenance", images.filter(~F.coalesce(F.col("crop_provenance").isin(*S.PROVENANCES), F.lit(False))), "id"))
    out.append(found("image size", images.filter((F.coalesce("width", F.lit(0)) < 1) | (F.coalesce("height", F.lit(0)) < 1)), "id"))
    out.append(found("box", annotations.filter((F.coalesce(F.size("bbox"), F.lit(0)) != 4) | ~(F.coalesce("area", F.lit(0.0)) > 0)), "id"))
    for check, child, key, parent in (("image dataset", images, "dataset_id", datasets), ("annotation image", annotations, "image_id", images), ("annotation category", annotations, "category_id", categories), ("dataset license", datasets, "license_id", licenses)):
        out.append(found(check, child.filter(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)).distinct(), key, "left_anti"), "id"))
    unsourced = F.size(F.array_except(F.coalesce(F.map_keys("groups"), F.array().cast("array<string>")), F.coalesce(F.map_keys("group_sources"), F.array().cast("array<string>")))) > 0
    out.append(found("group without source", images.filter(unsourced), "id"))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str, step: int = 1, limit: int | None = None) -> DataFrame:
    """Every step-th complete record of JSON lines files in file and line order; torn lines are skipped.

    Line order is the byte order within a file: the start of the block that a
    task reads, then the order within it, however many blocks a file is read in.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parsed = text.select("file", "block", "line", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).filter(F.coalesce(F.size(F.array_compact(F.array(*[F.col(f"r.{n}").cast("string") for n in (schema.fieldNames() if not isinstance(schema, str) else T._parse_datatype_string(schema).fieldNames())]))), F.lit(0)) > 0)
    if step == 1 and limit is None:
        return parsed.select("r.*")
    numbered = placed(parsed, ["file"], ["block", "line"], "n").filter(F.pmod(F.col("n") - 1, F.lit(step)) == 0)
    picked = numbered.orderBy("file", "n")
    return (picked.limit(limit) if limit is not None else picked).select("r.*")


def read_delimited(spark: SparkSession, path: str, numbers: list[str], sep: str = ",") -> DataFrame:
    """Delimited text (also gzipped) with stripped headers, all strings but the number columns; bad numbers are null."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in named.columns])


def taxon_map(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, ident once each; raises if a key has two ids."""
    per = rows.filter(F.col(ident).isNotNull()).groupBy(*keys).agg(F.count_distinct(ident).alias("n"), F.min(ident).alias(ident))
    clash = per.filter("n > 1").limit(5).collect()
    if clash:
        raise ValueError(f"keys with more than one id: {clash}")
    return per.drop("n")


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that the table has, whatever the case."""
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind, valid of files below a folder; hidden and thumbnail files are left out.

    kind comes from the first bytes; valid asks for 1 KB and an image signature.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(F.lower(F.decode(F.substring("content", 1, 15), "ISO-8859-1")).rlike("^\\s*<(!doctype|html)"), "html").otherwise("unknown")
    kept = files.filter(~name.startswith(".") & ~F.lower(name).isin("thumbs.db", "desktop.ini"))
    return kept.select("path", "length", kind.alias("kind"), (kind.isin("png", "jpeg") & (F.col("length") >= 1024)).alias("valid"))


def tar_members(spark: SparkSession, path: str, suffix: str | None = None, content: bool = False) -> DataFrame:
    """archive, key, ext, offset, size (and content) of the members of tar files, read header by header.

    The key is the member name before its first dot.  Only paths travel through
    Spark; a task opens its archives and seeks from header to header, so the
    bytes of members that the suffix excludes are never read.
    """
    import tarfile

    from pyarrow import fs

    fields = "archive string, key string, ext string, offset long, size long" + (", content binary" if content else "")

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                rows = []
                system, place = fs.FileSystem.from_uri(archive.replace("file:/", "file:///", 1) if archive.startswith("file:/") and not archive.startswith("file://") else archive)
                with system.open_input_file(place) as stream, tarfile.open(fileobj=stream, mode="r:") as tar:
                    for m in tar:
                        key, _, ext = m.name.rsplit("/", 1)[-1].partition(".")
                        if m.isfile() and (suffix is None or ext == suffix):
                            rows.append((archive, key, ext, m.offset_data, m.size, *([tar.extractfile(m).read()] if content else [])))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(index, fields)


def finished_partitions(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Values of a partition column that a finished write left (its _SUCCESS file exists); raises if it did not finish."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        raise FileNotFoundError(f"{path} was not finished")
    return spark.read.parquet(path).select(column).distinct()


def append_new(rows: DataFrame, held: DataFrame, key: str, path: str, partition_by: list[str]) -> None:
    """Writes those rows whose key ``held`` lacks; a second run writes nothing."""
    rows.join(held.select(key).distinct(), key, "left_anti").write.mode("append").partitionBy(*partition_by).parquet(path)
