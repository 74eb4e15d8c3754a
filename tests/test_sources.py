import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import collation as S
from tidemark.streaming import sessions


def document():
    return {
        "info": {"schema_version": "1.1", "description": "d"},
        "licenses": [{"id": 1, "name": "CC"}],
        "datasets": [{"id": 1, "name": "d", "license_id": 1}],
        "categories": [{"id": 1, "name": "Gadus morhua", "rank": "Species", "aphia_id": 126436, "lineage": {"Genus": "Gadus"}}],
        "images": [{"id": 1, "file_name": "A.png", "width": 10, "height": 10, "dataset_id": 1, "crop_provenance": "frame", "groups": {"deployment": "x"}, "group_sources": {"deployment": "file"}}, {"id": 2, "file_name": " a.PNG", "width": 0, "height": 10, "dataset_id": 9, "crop_provenance": "odd", "groups": {"site": "x"}}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 2, 2], "area": 4, "iscrowd": 0}, {"id": 2, "image_id": 7, "category_id": 1, "bbox": [0, 0, 2], "area": 4}],
    }


def test_document_and_problems(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(document(), indent=1))
    tables = S.read_document(spark, str(tmp_path / "d.json"))
    assert tables["images"].count() == 2 and tables["info"].head()["schema_version"] == "1.1"
    found = {(r["check"], r["key"]) for r in S.problems(tables).collect()}
    assert found == {("duplicate file name", "a.png"), ("image provenance", "2"), ("image size", "2"), ("image dataset", "2"), ("group without source", "2"), ("box", "2"), ("annotation image", "2")}


def test_lines_with_torn_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"i": i}) + "\n" for i in range(10)) + '{"i": 1')
    read = lambda **k: [r["i"] for r in S.read_lines(spark, str(tmp_path / "a.jsonl"), "i long", **k).collect()]
    assert sorted(read()) == list(range(10)) and read(step=3) == [0, 3, 6, 9] and read(step=3, limit=2) == [0, 3]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(" name \twidth\nx\t 3\ny\tbad\n")
    assert sorted(map(tuple, S.read_delimited(spark, str(tmp_path / "a.tsv"), ["width"], "\t").collect())) == [("x", 3.0), ("y", None)]


def test_taxon_map(spark):
    good = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, id long")
    assert S.taxon_map(good, ["k"], "id").count() == 1
    with pytest.raises(ValueError):
        S.taxon_map(good.unionByName(spark.createDataFrame([("a", 2)], "k string, id long")), ["k"], "id")


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, data in (("k1.json", b"{}"), ("k1.jpg", b"pixels"), ("k2.x.json", b"{}1")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    every = S.tar_members(spark, str(tmp_path / "*.tar"))
    assert {(r["key"], r["ext"], r["size"]) for r in every.collect()} == {("k1", "json", 2), ("k1", "jpg", 6), ("k2", "x.json", 3)}
    assert bytes(S.tar_members(spark, str(tmp_path / "*.tar"), "jpg", True).head()["content"]) == b"pixels"


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 2000)
    (tmp_path / "b.png").write_bytes(b"<!DOCTYPE html><html>" + b" " * 2000)
    (tmp_path / "Thumbs.db").write_bytes(b"0")
    assert sorted((r["kind"], r["valid"]) for r in S.image_files(spark, str(tmp_path)).collect()) == [("html", False), ("png", True)]


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, p int")
    out = str(tmp_path / "t")
    S.append_new(df, df.filter("false"), "k", out, ["p"])
    S.append_new(df, spark.read.parquet(out), "k", out, ["p"])
    assert spark.read.parquet(out).count() == 2 and S.finished_partitions(spark, out, "p").count() == 2
    with pytest.raises(FileNotFoundError):
        S.finished_partitions(spark, str(tmp_path / "none"), "p")


def test_streams(spark, tmp_path):
    rows = [(i, "u" + str(i % 2), 10**9 + 60 * i, float(i)) for i in range(20)] + [(3, "u1", 10**9 + 180, 3.0)]
    df = spark.createDataFrame(rows, "i long, u string, s long, value double").select("i", "u", F.timestamp_seconds("s").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))

    def run(make, mode, name):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    batch = sessions.windowed(df, "ts", ["u"], "5 minutes").count()
    assert run(lambda s: sessions.windowed(s, "ts", ["u"], "5 minutes"), "complete", "w").count() == batch
    assert run(lambda s: sessions.first_sightings(s, "i", "ts", "1 hour"), "append", "f").count() == 20
    assert sessions.sessions(df, "ts", ["u"], "3 minutes").count() == 2
    assert {r["u"]: r["largest"] for r in run(lambda s: sessions.running_largest(s, "u", "value"), "update", "r").collect()} == {"u0": 18.0, "u1": 19.0}


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    import json

    from tidemark.sources import collation

    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"i": i, "pad": "x" * 200}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [r["i"] for r in collation.read_lines(spark, f"file://{tmp_path}/a.jsonl", "i int, pad string", step=7).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(range(0, 2000, 7))
