import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M

DOCS = "doc_id long, source string, text string, tokens array<int>"
TARGETS = "source string, target_share double, max_repeats int"
pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no vocabulary files")


def documents(spark, partitions=3):
    rng = random.Random(0)
    words = "net reef tide cable frame lamp depth coral".split()
    rows = [(i, ["Web_Crawl", "web-crawl ", "web_crawl"][i % 3] if i % 3 else "log", " ".join(rng.choice(words) for _ in range(rng.randint(5, 80))), None) for i in range(600)]
    rows += [(9000, "log", "long " * 20_000, None), (9001, "log", None, None), (9002, "log", "", None), (9003, None, "no source", None), (None, "log", "no id", None), (9004, "unlisted", "x y", None), rows[0], rows[1]]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def targets(spark, rows=(("web_crawl", 0.6, 2), ("log", 0.3, 1), ("absent", 0.1, 4), (None, 0.1, 1), ("log", 0.3, 1))):
    return spark.createDataFrame(list(rows), TARGETS)


@pytest.mark.parametrize("size", [1, 2, 5, 16, 999])
def test_permutation(size):
    for key in (0, 7):
        assert sorted(M.permuted(np.arange(size), size, key)) == list(range(size))
    if size > 100:
        assert (M.permuted(np.arange(size), size, 0) != M.permuted(np.arange(size), size, 7)).mean() > 0.9


def test_blocks_hold_every_token_once(spark):
    from tidemark.session import Scratch

    tokens = M.tokenise(documents(spark)).cache()
    packed = M.pack(Scratch(spark, "t"), tokens, 64)
    want = {r["source"]: r["n"] for r in tokens.dropDuplicates(["doc_id"]).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    got = {r["source"]: (r["n"], r["b"]) for r in packed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("b")).collect()}
    assert {s: n for s, (n, _) in got.items()} == want and all(b == -(-want[s] // 64) for s, (_, b) in got.items())
    whole = [t for r in packed.filter("source = 'log'").orderBy("block_no").collect() for t in r["tokens"]]
    h = F.xxhash64("source", "doc_id")
    docs = [r["tokens"] for r in tokens.filter("source = 'log'").dropDuplicates(["doc_id"]).orderBy(h, "doc_id").collect()]
    assert whole == [t for d in docs for t in d]


def test_ranges_of_one_source(spark, monkeypatch):
    """Cut into many hash ranges, every token stands once and the numbers have no gap."""
    from tidemark.session import Scratch

    monkeypatch.setattr(M, "RANGE_TOKENS", 500)
    monkeypatch.setattr(M, "PREFIX", 4)
    tokens = M.tokenise(documents(spark)).cache()
    packed = M.pack(Scratch(spark, "t"), tokens, 64)
    want = tokens.dropDuplicates(["source", "doc_id"]).groupBy("source").agg(F.sum("n").alias("n"))
    got = packed.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    for r in packed.groupBy("source").agg(F.count("*").alias("c"), F.count_distinct("block_no").alias("d"), F.min("block_no").alias("a"), F.max("block_no").alias("b")).collect():
        assert r["c"] == r["d"] == r["b"] + 1 and r["a"] == 0


def test_shares_repeats_and_reruns(spark):
    mixed = M.mix(spark, documents(spark), targets(spark), block=64).cache()
    report = {r["source"]: r for r in M.actual_shares(mixed, targets(spark)).collect()}
    assert abs(report["web_crawl"]["share"] - 2 / 3) < 0.06 and abs(report["log"]["share"] - 1 / 3) < 0.06 and report["absent"]["tokens"] == 0
    assert report["web_crawl"]["most_repeats"] <= 2 and report["log"]["most_repeats"] <= 1
    slots = mixed.select("shard", "slot").distinct().count()
    assert slots == mixed.count() and mixed.groupBy("shard").count().filter("count > 64").count() == 0
    again = M.mix(spark, documents(spark, 5), targets(spark), block=64)
    key = lambda df: sorted((r["shard"], r["slot"], r["source"], r["block_no"]) for r in df.collect())
    assert key(mixed) == key(again)


def test_draw_never_exceeds_a_source():
    blocks, repeats = {"a": 10, "b": 1000}, {"a": 3, "b": 1}
    share, slots = M.shares_for({"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 5120, "b": 512_000}, blocks, repeats)
    assert share == {"a": 0.5, "b": 0.5} and slots == 60
    used = sum(got for group in range(-(-slots // M.group_size(share))) for _, _, got in M.draw_group(share, slots, group))
    assert used[0] <= 30 and used.sum() == 60


@pytest.mark.parametrize("seed", range(5))
def test_groups_follow_each_other(seed):
    """Each source's slots are numbered without gap over all shards, within its repeats and near its share."""
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.randint(1, 30))]
    blocks = {n: rng.randint(1, 3000) for n in names}
    tokens = {n: b * 500 - rng.randint(0, 400) for n, b in blocks.items()}
    weight = {n: rng.random() for n in names}
    repeats = {n: rng.randint(1, 5) for n in names}
    share, slots = M.shares_for(weight, tokens, blocks, repeats)
    at = np.zeros(len(share), np.int64)
    for group in range(-(-slots // M.group_size(share))):
        for shard, first, got in M.draw_group(share, slots, group, seed):
            assert (first == at).all() and (got >= 0).all() and got.sum() == min(M.SHARD_BLOCKS, slots - shard * M.SHARD_BLOCKS)
            at = at + got
    assert at.sum() == slots and all(n <= repeats[s] * blocks[s] for s, n in zip(share, at, strict=True))
    assert all(abs(n - w * slots) <= len(share) for n, w in zip(at, share.values(), strict=True))


def test_permutations_differ_by_source_pass_and_seed():
    seeds = (0, 7, 12345, 123456789012)
    keys = {(s, p, seed): M.pass_key(s, p, seed) for s in ("web_crawl", "crawl", "log", "field_log") for p in range(4) for seed in seeds}
    assert len(set(keys.values())) == len(keys)
    orders = [M.permuted(np.arange(200), 200, k) for k in keys.values()]
    assert len({tuple(o) for o in orders}) == len(keys)
    assert max((a == b).mean() for i, a in enumerate(orders) for b in orders[:i]) < 0.08


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert M.mix(spark, none, targets(spark)).count() == 0
    assert M.mix(spark, documents(spark), targets(spark, [])).count() == 0
    assert M.actual_shares(M.mix(spark, none, targets(spark)), targets(spark)).agg(F.sum("tokens")).head()[0] == 0
