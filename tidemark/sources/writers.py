"""Writers that leave either a whole result or none: shards, review rows, manifests, single tables."""

from __future__ import annotations

import csv
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranks import total_before


def _open(spark: SparkSession, path: str):
    """(file system, path) of the cluster's file system API."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, hadoop


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and moved there, so that no reader sees half of it."""
    fs, place, hadoop = _open(spark, path)
    part = hadoop.Path(path + ".part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"could not move {part} to {place}")


def write_manifest(spark: SparkSession, path: str, config: dict, **counts: DataFrame) -> dict:
    """A JSON file of the configuration and, for each DataFrame of (name, n) rows, its counts; returns what was written.

    The counts are of report tables: a row per source, split or reason.
    """
    found = {name: {str(r[0]): r[1] for r in df.collect()} for name, df in counts.items()}  # report tables
    out = {"config": config, "counts": found}
    write_text(spark, path, json.dumps(out, indent=1, sort_keys=True, default=str))
    return out


def write_review(rows: DataFrame, path: str) -> DataFrame:
    """Review rows (item, source_path, reason) as a folder of delimited text with a header, also where there are none; read again."""
    named = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in ("item", "source_path", "reason")])
    # a writer of an empty DataFrame leaves no file, and a reader then no columns
    header = rows.sparkSession.createDataFrame([("item", "source_path", "reason")], named.schema)
    named.write.mode("overwrite").option("header", False).option("quoteAll", True).option("escape", "\"").csv(path)
    header.coalesce(1).write.mode("append").option("header", False).option("quoteAll", True).option("escape", "\"").csv(path)
    text = rows.sparkSession.read.schema(named.schema).option("quote", '"').option("escape", '"').csv(path)
    return text.filter("not (item <=> 'item' and source_path <=> 'source_path' and reason <=> 'reason')")


def write_csv(rows: DataFrame, path: str, order: list[str], most: int = 1_000_000) -> int:
    """A small report as one delimited file in a stated order, complete or absent; raises beyond ``most`` rows."""
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows are no report; write a folder instead")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(rows.columns)
    for r in rows.orderBy(*order).toLocalIterator():  # at most ``most`` rows
        writer.writerow(["" if v is None else v for v in r])
    write_text(rows.sparkSession, path, out.getvalue())
    return n


def shard_numbers(rows: DataFrame, source: str, key: str, size: str, target_bytes: int) -> DataFrame:
    """rows with shard, from 0 per source: a shard ends with the record that brings it to target_bytes of running total.

    The running totals of a hot source come from those of ranges of keys, so
    no task holds a source; a null size counts as 0.
    """
    before = total_before(rows, [source], [key], F.col(size).cast("long"), "_before")
    return before.withColumn("shard", F.floor(F.col("_before") / target_bytes).cast("int")).drop("_before")


def write_shards(rows: DataFrame, out: str, prefix: str, source: str, key: str, payload: str, meta: Column, target_bytes: int, suffix: str = "jpg") -> DataFrame:
    """Tar files ``<prefix>-<source>-<number>.tar`` under ``out`` with, per record, its payload and a JSON file of ``meta``; returns (archive, source, idx, records, bytes).

    A shard is written by one task beside its place and moved there when
    complete; a task that is run again writes the same bytes again.  Records
    without a key or payload are left out; a key that repeats within its source
    counts once (the smallest payload).
    """
    from pyarrow import fs

    kept = rows.filter(F.col(key).isNotNull() & F.col(source).isNotNull() & F.col(payload).isNotNull())
    one = kept.select(F.col(source).alias("source"), F.col(key).cast("string").alias("key"), F.struct(F.col(payload).alias("payload"), F.to_json(meta).alias("meta")).alias("r")).groupBy("source", "key").agg(F.min("r").alias("r"))
    sized = one.select("source", "key", F.length("r.payload").alias("size"), "r.payload", "r.meta")
    numbered = shard_numbers(sized.select("source", "key", "size"), "source", "key", "size", target_bytes)
    ready = sized.drop("size").join(numbered, ["source", "key"]).repartition("source", "shard").sortWithinPartitions("source", "shard", "key")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tar, stream, state, done = None, None, None, [0, 0], []
        system, base = fs.FileSystem.from_uri(out)
        system.create_dir(base, recursive=True)

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))

        def close() -> None:
            if at is None:
                return
            tar.close()
            stream.close()
            name = f"{prefix}-{at[0]}-{at[1]:06d}.tar"
            system.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((name, at[0], at[1], *state))

        for frame in frames:
            for s, n, k, data, text in zip(frame["source"], frame["shard"], frame["key"], frame["payload"], frame["meta"], strict=True):
                if (s, n) != at:
                    close()
                    at, state = (s, n), [0, 0]
                    stream = system.open_output_stream(f"{base}/{prefix}-{s}-{n:06d}.tar.part")
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT)
                add(f"{k}.{suffix}", bytes(data))
                add(f"{k}.json", text.encode())
                state = [state[0] + 1, state[1] + len(data)]
        close()
        yield pd.DataFrame(done, columns=["archive", "source", "idx", "records", "bytes"])

    schema = "archive string, source string, idx int, records long, bytes long"
    from tidemark.session import Scratch

    return Scratch(rows.sparkSession, "shards").save(ready.select("source", "shard", "key", "payload", "meta").mapInPandas(write, schema), "written")


def subset_archives(members: DataFrame, wanted: DataFrame, out: str, prefix: str, source: Column, target_bytes: int) -> DataFrame:
    """The wanted keys' files of archives (key, ext, content), copied byte by byte into new archives; (archive, source, idx, records, bytes)."""
    own = members.join(wanted.select("key").distinct(), "key", "left_semi")
    per = own.groupBy("key").agg(F.max(F.when(F.col("ext") != "json", F.col("content"))).alias("payload"), F.max(F.when(F.col("ext") == "json", F.col("content"))).alias("meta"), F.max(F.when(F.col("ext") != "json", F.col("ext"))).alias("ext"))
    rows = per.withColumn("source", source).withColumn("meta", F.from_json(F.decode("meta", "UTF-8"), "map<string,string>"))
    return write_shards(rows, out, prefix, "source", "key", "payload", F.col("meta"), target_bytes)


def find_runs(spark: SparkSession, root: str, name: str = "manifest.json") -> DataFrame:
    """path, first, second, third, content of the manifests ``<root>/<first>/<second>/<third>/<name>`` (partition discovery by folder)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    parts = F.split("path", "/")
    return files.filter(F.size(parts) >= 4).select("path", *[F.element_at(parts, -4 + i).alias(c) for i, c in enumerate(("first", "second", "third"))], F.decode("content", "UTF-8").alias("content"))


def image_sizes(files: DataFrame) -> DataFrame:
    """path, width, height of PNG and JPEG files (path, content) from their headers; null where there is none."""

    def size(data: bytes) -> tuple[int | None, int | None]:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
            return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
        at = 2 if data[:2] == b"\xff\xd8" else len(data)
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None, None
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # start of frame
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [size(bytes(c)) if c is not None else (None, None) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int")
