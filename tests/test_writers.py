import json
import os
import struct

from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.sources import collation, writers


def test_shards_are_written_read_and_verified(spark, tmp_path):
    out = f"file://{tmp_path}/shards"
    rows = [(f"k{i:03d}", "yolo-bruv" if i % 3 else "ozfish", bytes([i % 250]) * (100 + i), i) for i in range(90)] + [("k001", "yolo-bruv", b"\x01" * 101, 1), (None, "ozfish", b"x", 0), ("gone", "ozfish", None, 0)]
    df = spark.createDataFrame(rows, "key string, source string, data binary, n int").repartition(4)
    made = {(r["source"], r["idx"]): (r["archive"], r["records"]) for r in writers.write_shards(df, out, "crops", "source", "key", "data", F.struct("key", "n"), 2500).collect()}
    assert sum(n for _, n in made.values()) == 90 and made["ozfish", 0][0] == "crops-ozfish-000000.tar"
    assert {s for s, _ in made} == {"ozfish", "yolo-bruv"} and not [f for f in os.listdir(tmp_path / "shards") if f.endswith(".part")]
    read = collation.tar_members(spark, out, content=True)
    from tidemark.functions import keys as K

    name = F.element_at(F.split("archive", "/"), -1)
    members = read.select(name.alias("archive"), K.shard_source(name, "crops").alias("source"), K.shard_number(name).alias("idx"), "key", "ext", "size", F.sha2("content", 256).alias("digest"))
    due = df.filter("key is not null and data is not null").select("key", "source", F.length("data").cast("long").alias("size"), F.sha2("data", 256).alias("digest")).distinct()
    assert all(r["ok"] for r in checks.verify_shards(due, members).collect())
    broken = {r["check"]: r["failures"] for r in checks.verify_shards(due.filter("key <> 'k005'"), members.filter("not (key = 'k007' and ext = 'json') and idx <> 1")).collect()}
    assert broken["pairs"] == 1 and broken["extra"] in (0, 1) and broken["missing"] > 0 and broken["numbered"] >= 1 and broken["digest"] == 0
    part = writers.subset_archives(read.drop("archive"), spark.createDataFrame([("k001",), ("k002",), ("none",)], "key string"), f"file://{tmp_path}/dev", "dev", F.lit("all"), 10_000).collect()
    assert [(r["archive"], r["records"]) for r in part] == [("dev-all-000000.tar", 2)]


def test_shard_numbers_by_running_bytes(spark):
    df = spark.createDataFrame([("s", f"k{i}", 40) for i in range(6)] + [("t", "a", None), ("t", "b", 5)], "source string, key string, size long")
    got = sorted((r["source"], r["key"], r["shard"]) for r in writers.shard_numbers(df, "source", "key", "size", 100).collect())
    assert [x[2] for x in got] == [0, 0, 0, 1, 1, 2, 0, 0]


def test_reports_and_reviews(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "name string, n int")
    assert writers.write_csv(df, f"file://{tmp_path}/r.csv", ["name"]) == 2 and (tmp_path / "r.csv").read_text() == "name,n\na,\nb,2\n"
    assert writers.write_csv(df.filter("false"), f"file://{tmp_path}/r.csv", ["name"]) == 0 and (tmp_path / "r.csv").read_text() == "name,n\n"
    assert not (tmp_path / "r.csv.part").exists()
    review = spark.createDataFrame([('odd "name", with, commas', "no video"), (None, "x")], "item string, reason string")
    again = writers.write_review(review, f"file://{tmp_path}/review")
    assert {tuple(r) for r in again.collect()} == {('odd "name", with, commas', None, "no video"), (None, None, "x")}
    none = writers.write_review(review.filter("false"), f"file://{tmp_path}/empty")
    assert none.columns == ["item", "source_path", "reason"] and none.count() == 0
    writers.write_manifest(spark, f"file://{tmp_path}/a/b/c/manifest.json", {"k": 20}, reasons=review.groupBy("reason").count())
    found = writers.find_runs(spark, f"file://{tmp_path}").collect()
    assert [(r["first"], r["second"], r["third"]) for r in found] == [("a", "b", "c")] and json.loads(found[0]["content"])["counts"]["reasons"] == {"no video": 1, "x": 1}


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02"
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\x00" * 10 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 33, 44) + b"\x00" * 12
    files = spark.createDataFrame([("a", png), ("b", jpeg), ("c", b"<html>"), ("d", b""), ("e", None)], "path string, content binary")
    assert {r["path"]: (r["width"], r["height"]) for r in writers.image_sizes(files).collect()} == {"a": (640, 480), "b": (44, 33), "c": (None, None), "d": (None, None), "e": (None, None)}
