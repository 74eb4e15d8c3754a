import json

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import compaction as C

SCHEMA = "file_id long, file_name string, source string, payload string, crop_key string"


def record(key, **more):
    return {"crop_key": key, "source": "ozfish", "file_name": "a.jpg", "native_width": 10, "native_height": 20, "depth_m": 1.5, "note": None} | more


def test_hilbert_codes_are_a_path():
    side = np.arange(8)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    codes = C.hilbert_codes(points, bits=3)
    assert sorted(codes) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(codes)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_records_of_lines_arrays_and_damage():
    a, b = json.dumps(record("a")), json.dumps(record("b"))
    assert [r["crop_key"] for r in C.records_in(f"{a}\n{b}\n")] == ["a", "b"]
    assert [r["crop_key"] for r in C.records_in(f"[{a}, {b}]")] == ["a", "b"]
    assert [r["crop_key"] for r in C.records_in(f"{a}\r\n{b[:40]}")] == ["a"]
    assert [r["crop_key"] for r in C.records_in(f"{a[:30]}\n{b}")] == ["b"]
    assert list(C.records_in("")) == list(C.records_in(None)) == list(C.records_in("no json")) == []


def test_records_after_a_damaged_one_in_the_same_line():
    a, b, c, d = (json.dumps(record(x, weight={"kg": 1, "crop_key": "no"}, parts=[[{"crop_key": "no"}], {"crop_key": "no"}])) for x in "abcd")
    keys = lambda text: [r["crop_key"] for r in C.records_in(text)]
    assert keys(f"[{a}, {b.replace('1.5', '1.5.5')}, {c}, {d}]") == ["a", "c", "d"]  # a bad value before nested objects
    assert keys(f"[{a}, {b[:-1]} tru}}, {c}, {d}]") == ["a", "c", "d"]  # after them
    assert keys(f"[{a}, {b[:40]}, {c}, {d}]") == ["a", "c", "d"]  # cut off in the middle
    assert keys(f"[{a}, {b.replace('a.jpg', 'a {} b, {1}')[:-1]}, {c}") == ["a", "c"]  # braces in a string
    assert keys(f"{a}\n{b[:-3]}\n{c}") == ["a", "c"] and keys(b[:-3]) == []
    assert list(C.records_in(f"{b[:-3]}\n" + '{"only": "other fields"}')) == [{"only": "other fields"}]


def test_each_record_once(spark, rows):
    long = "x" * 200_000
    payloads = [
        (1, "f", "ozfish", json.dumps(record("a")) + "\n" + json.dumps(record("b", source=None)), "clash"),
        (2, "f", " OzFish", json.dumps([record("a", native_width="10"), record("c", note=long)]), None),
        (3, "f", None, json.dumps(record("d", source=None))[:60], None),
        (4, "f", None, None, None),
        (5, "f", "fishwio", "", None),
        (6, "f", "fishwio", json.dumps(record(None, source=None)) + "\n" + json.dumps(record(None, source=None)), None),
        (7, "f", "fishwio", json.dumps(record("e", source=None, weight={"kg": 1})), None),
    ]
    done = C.compact(spark, spark.createDataFrame(payloads, SCHEMA))
    assert rows(done.files.filter("crop_key is not null"), "crop_key", "source", "occurrences") == [("a", "ozfish", 2), ("b", "ozfish", 1), ("c", "ozfish", 1), ("e", "fishwio", 1)]
    assert done.files.filter("crop_key is null").head()["occurrences"] == 2
    assert done.files.filter("crop_key = 'c'").head()["note"] == long
    assert json.loads(done.files.filter("crop_key = 'e'").head()["extra"]) == {"weight": {"kg": 1}}
    assert rows(C.repeated(done.files), "crop_key") == [("a",)]
    assert done.manifest.agg(F.sum("delivered")).head()[0] == 7


def test_files_are_balanced_and_hot_codes_split(spark):
    # a third of all records share one code
    payloads = [(i, "f", "ozfish" if i % 4 else "fishwio", json.dumps(record(f"k{i}", source=None, native_width=50 if i % 3 == 0 else i)), None) for i in range(3000)]
    done = C.compact(spark, spark.createDataFrame(payloads, SCHEMA), target_bytes=8000)
    sizes = [r["bytes"] for r in done.manifest.collect()]
    assert done.files.count() == 3000 and len(sizes) > 5
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_files_lie_where_the_caller_says(spark, tmp_path):
    payloads = [(i, "f", "ozfish" if i % 4 else "fishwio", json.dumps(record(f"k{i}", source=None, native_width=i)), None) for i in range(900)]
    done = C.compact(spark, spark.createDataFrame(payloads, SCHEMA), target_bytes=8000, path=f"file://{tmp_path}/out")
    assert done.path == f"file://{tmp_path}/out" and spark.read.parquet(done.path).count() == 900
    written = [len(list(d.glob("*.parquet"))) for d in tmp_path.glob("out/source=*/file_no=*")]
    assert len(written) == done.manifest.count() > 3 and set(written) == {1}


def test_a_record_lost_on_the_way_is_noticed(spark, monkeypatch):
    import pytest

    payloads = [(i, "f", "ozfish", json.dumps(record(f"k{i}")), None) for i in range(50)]
    save = C.Scratch.save
    monkeypatch.setattr(C.Scratch, "save", lambda self, df, name, **more: save(self, df.filter("crop_key <> 'k7'") if name == "records" else df, name, **more))
    with pytest.raises(RuntimeError, match="payloads deliver"):
        C.compact(spark, spark.createDataFrame(payloads, SCHEMA))


def test_empty_table(spark):
    done = C.compact(spark, spark.createDataFrame([], SCHEMA))
    assert done.files.count() == done.manifest.count() == 0
