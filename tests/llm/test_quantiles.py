import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crop_sizes, quantiles as Q

SHARD = "crop_key string, campaign string, source string, build_no int, native_width int, native_height int, bbox array<double>, received_at string"


def test_rank_error_of_merged_sketches():
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=20_000) for _ in range(12)]
    k = 256
    merged = Q.merge([Q.sketch(p, k, i) for i, p in enumerate(parts)], k, 1)
    every = np.sort(np.concatenate(parts))
    assert sum(len(x) << h for h, x in enumerate(merged)) == len(every)
    assert sum(map(len, merged)) < 4 * k
    for q in (0.01, 0.1, 0.5, 0.9, 0.99):
        rank = np.searchsorted(every, Q.at_ranks(merged, np.array([q]))[0]) / len(every)
        assert abs(rank - q) <= Q.rank_error(k)


def test_small_sketches_are_exact():
    values = np.array([3.0, 1.0, 2.0, 2.0])
    assert list(Q.at_ranks(Q.merge([Q.sketch(values[:2]), Q.sketch(values[2:])]), np.array([0.1, 0.5, 0.9, 1.0]))) == [1, 2, 3, 3]
    assert np.isnan(Q.at_ranks([], np.array([0.5]))).all()


@pytest.mark.parametrize("partitions", [1, 7])
def test_partials_merge_to_the_whole(spark, partitions):
    df = spark.createDataFrame([("hot", float(i)) for i in range(3000)] + [("b", 1.0), ("b", None), ("b", float("nan")), (None, 4.0)], "key string, v double").repartition(partitions)
    parts = Q.build_sketches(df, ["key"], "v", k=512)
    got = {r["key"]: r for r in Q.percentiles(Q.merge_sketches(parts, ["key"], 512), ["key"], {"p50": 0.5}, 512).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"hot": 3000, "b": 1, None: 1}
    assert got["hot"]["p50_low"] <= 1499 <= got["hot"]["p50_high"] and got["b"]["p50"] == 1 and got[None]["p50"] == 4
    assert Q.percentiles(Q.merge_sketches(Q.build_sketches(df.filter("false"), ["key"], "v"), ["key"]), ["key"], {"p50": 0.5}).count() == 0


def records(spark, n=400):
    rows = [(f"c{i}", "cmp", [" OzFish", "ozfish"][i % 2], 1 + i % 3, 20 + i, 30 + i, [0.0, 0.0, 5.0 + i, 9.0 + i], "2025") for i in range(n)]
    rows += [rows[0], rows[5]] + [("z1", "cmp", "ozfish", 1, None, 5, None, None), ("z2", "cmp", "ozfish", 1, -4, 5, [1.0], None), ("z3", None, None, None, 0, 0, [None, None, None, None], None)]
    return spark.createDataFrame(rows, SHARD)


def published(spark, rows):
    return spark.createDataFrame(rows, "campaign string, build_no int, source string, definition string, p10 int, median int, p90 int, n long")


def test_wrong_sizes(spark):
    right = [np.percentile([20 + i for i in range(400) if 1 + i % 3 <= b], [10, 50, 90]).astype(int).tolist() for b in (1, 3)]
    table = published(spark, [("cmp", 1, "ozfish", "shard_native", *right[0], 1), ("cmp", 3, "OZ_fish", "shard_native", *right[1], 1), ("cmp", 2, "ozfish", "ann_bbox", 1, 2, 3, 1), ("cmp", 2, "ozfish", "ann_bbox", 1, 2, 3, 1), ("cmp", 2, "ozfish", "shard_native", None, None, None, 1), ("none", 2, "ozfish", "ann_bbox", 1, None, None, 1)])
    got = sorted(map(tuple, crop_sizes.wrong_sizes(spark, records(spark), table).collect()))
    assert got == [("cmp", 2, "ozfish", "ann_bbox"), ("none", 2, "ozfish", "ann_bbox")]


def test_open_groups_get_larger_sketches(spark):
    # a tiny sketch leaves the bounds wide, so larger ones decide
    rec = records(spark, 4000)
    median = float(np.median([20 + i for i in range(4000)]))
    near, far = int(median * 1.19), int(median * 1.22)
    table = published(spark, [("cmp", 3, "ozfish", "shard_native", None, near, None, 1)]), published(spark, [("cmp", 3, "ozfish", "shard_native", None, far, None, 1)])
    assert crop_sizes.wrong_sizes(spark, rec, table[0], k=32).count() == 0
    assert crop_sizes.wrong_sizes(spark, rec, table[1], k=32).count() == 1


def test_empty_tables(spark):
    assert crop_sizes.wrong_sizes(spark, records(spark).filter("false"), published(spark, [])).count() == 0
    assert crop_sizes.measurements(records(spark).withColumn("definition", F.lit(1)).withColumn("side", F.lit(2))).count() > 0


def test_groups_open_to_the_last_are_decided_by_the_value(spark, monkeypatch):
    monkeypatch.setattr(crop_sizes, "LAST_K", 64)
    rec = records(spark, 4000)
    median = float(np.median([20 + i for i in range(4000)]))
    table = published(spark, [("cmp", 3, "ozfish", "shard_native", None, int(median * 1.3), None, 1), ("cmp", 3, "ozfish", "ann_bbox", None, int(median * 1.02), None, 1)])
    assert [tuple(r) for r in crop_sizes.wrong_sizes(spark, rec, table, k=16).collect()] == [("cmp", 3, "ozfish", "shard_native")]


def test_compacted_sketches_keep_to_their_rank_error(spark):
    got = crop_sizes.rank_errors(spark, records(spark, 3000), 64).collect()
    assert len(got) == 6 and all(r["p10"] and r["median"] and r["p90"] for r in got)
    sizes = crop_sizes.sketches_per_build(spark, records(spark, 3000), 64).select("n", F.size("levels").alias("levels"), F.aggregate("levels", F.lit(0), lambda a, x: a + F.size(x)).alias("held")).collect()
    assert all(r["levels"] > 1 and r["held"] < r["n"] / 3 for r in sizes)
