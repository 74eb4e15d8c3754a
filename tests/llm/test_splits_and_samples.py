from collections import Counter
from hashlib import sha256

import pytest

from tidemark.llm import sampling as P
from tidemark.llm import splits as S

CROPS = "crop_key string, source string, split string, grp string, added_at string, component string, weight long"


def crops(spark, rows):
    return spark.createDataFrame([(k, s, sp, g, None, "clash", 1) for k, s, sp, g in rows], CROPS)


def dev(spark, rows=(("ozfish", "A000001"), ("fishwio", "A000001"), ("ozfish", "B000002"))):
    return spark.createDataFrame([(i, s, d, None, 1, 1) for i, (s, d) in enumerate(rows)], "order_no long, source string, deployment string, survey string, crops long, units long")


def groups(spark):
    rows = [("fathomnet", "KELDA:C18", "cruise"), ("fathomnet", "KELDA:C18:D1", "dive"), ("fathomnet", "KELDA:C181:D1", "dive"), ("fathomnet", "KELDA:C18", "cruise")]
    return spark.createDataFrame(rows, "source string, deployment string, derived_level string")


BASE = [
    ("a", "OzFish", "train", "A-1"), ("b", "ozfish", " Train", "a000001 "), ("c", "fishwio", "lock", "A000001"), ("d", "ozfish", "dev", "B000002"), ("e", "ozfish", "lock", "B_0002"),
    ("f", "fathomnet", "train", "KELDA|C18|D01"), ("g", "fathomnet", "lock", "kelda:c18:d7"), ("h", "fathomnet", "dev", "KELDA:C181:D1"), ("i", "fathomnet", "", "KELDA:C181:D1"), ("j", "fathomnet", None, None), ("k", "fathomnet", "ungrouped", ""), ("l", None, "dev", "x"), ("d", "ozfish", "dev", "B000002"),
]


def test_conflicts(spark, rows):
    assert rows(S.conflicting(spark, crops(spark, BASE), dev(spark), groups(spark)), "source", "deployment") == [("fathomnet", "KELDA:C18"), ("ozfish", "B000002")]


def test_assignment_keeps_and_fills(spark):
    more = [(f"n{i}-{j}", "ozfish", None, f"N{i}") for i in range(120) for j in range(5)] + [(f"hot{j}", "ozfish", None, "HOT1") for j in range(100)]
    got = {r["crop_key"]: r for r in S.assign(spark, crops(spark, BASE + more), dev(spark), groups(spark)).collect()}
    assert got["a"]["split"] == got["b"]["split"] == "train" and got["c"]["split"] == "lock" and got["h"]["split"] == got["i"]["split"] == "dev"
    assert got["d"]["status"] == got["g"]["status"] == "quarantined" and got["d"]["split"] is None and got["j"]["status"] == got["k"]["status"] == "ungrouped"
    assert len({got[f"n3-{j}"]["split"] for j in range(5)}) == 1 and len({got[f"hot{j}"]["split"] for j in range(100)}) == 1
    share = Counter(r["split"] for r in got.values() if r["split"])
    assert abs(share["train"] / sum(share.values()) - 0.7) < 0.06 and abs(share["lock"] / sum(share.values()) - 0.15) < 0.06


def test_kept_state_and_conflicting_merge(spark):
    entities = spark.createDataFrame([("a", ["train"]), ("b", ["lock"]), ("c", [])], "entity string, claimed array<string>")
    none = spark.createDataFrame([], "a string, b string")
    first = S.fill_new(spark, S.merge_state(spark, None, entities, none), spark.createDataFrame([("a", 7), ("b", 1), ("c", 2)], "entity string, weight long"))
    c = {r["entity"]: r["split"] for r in first.collect()}["c"]
    assert c in ("dev", "train", "lock")
    # new links: d joins a and keeps its split; a and b meet and are quarantined
    link = lambda *e: spark.createDataFrame(list(e), "a string, b string")
    new = spark.createDataFrame([("d", [])], "entity string, claimed array<string>")
    grown = {r["entity"]: r for r in S.merge_state(spark, first, new, link(("a", "d"))).collect()}
    assert grown["d"]["split"] == "train" and grown["d"]["component"] == "a" and grown["c"]["split"] == c
    met = S.merge_state(spark, first, new, link(("a", "d"), ("d", "b")))
    assert {r["entity"]: r["status"] for r in met.collect()} == {"a": "quarantined", "b": "quarantined", "d": "quarantined", "c": "kept"}
    # the quarantine outlives the links
    again = {r["entity"]: r["status"] for r in S.merge_state(spark, met, new.filter("false"), none).collect()}
    assert again["a"] == again["d"] == "quarantined"


def test_component_table_outlives_the_run(spark, tmp_path):
    from tidemark.session import Kept

    listed = S.deployments_table(dev(spark), groups(spark)).cache()
    timed = lambda rows: spark.createDataFrame([(k, s, sp, g, t, "clash", 1) for k, s, sp, g, t in rows], CROPS)
    kept = Kept(spark, f"file://{tmp_path}/components")
    first = S.advance(spark, kept, timed([(f"a{i}", "ozfish", None, f"N{i}", None) for i in range(200)] + [("x", "ozfish", "lock", "OLD1", None)]), listed, S.TARGETS)
    one = {r["entity"]: r["split"] for r in first.collect()}
    assert one["ozfish|old1"] == "lock" and None not in one.values()
    second = S.advance(spark, kept, timed([("y", "ozfish", None, "OLD1", None), ("z", "ozfish", "dev", "OLD1 ", None), ("w", "ozfish", None, "NEW1", None)]), listed, S.TARGETS)
    two = {r["entity"]: r for r in second.collect()}
    assert {e: two[e]["split"] for e in one if e != "ozfish|old1"} == {e: s for e, s in one.items() if e != "ozfish|old1"}
    assert two["ozfish|old1"]["status"] == "quarantined" and two["ozfish|old1"]["weight"] == 3 and two["ozfish|new1"]["split"]
    third = {r["entity"]: (r["split"], r["status"] == "quarantined") for r in S.advance(spark, kept, timed([]), listed, S.TARGETS).collect()}
    assert third == {e: (r["split"], r["status"] == "quarantined") for e, r in two.items()} and kept.versions() == [1, 2, 3]


def test_long_chains_of_links_merge_over_runs(spark):
    """Links that arrive over three runs and make one chain of 60: pointer jumping over the kept table."""
    claim = lambda *e: spark.createDataFrame([(x, c) for x, c in e], "entity string, claimed array<string>")
    state = None
    for run in range(3):
        links = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(run, 59, 3)], "a string, b string")
        state = S.merge_state(spark, state, claim(*((f"c{i:02d}", ["dev"] if i == 30 else []) for i in range(60))), links)
    assert {(r["component"], r["split"], r["status"]) for r in state.collect()} == {("c00", "dev", "kept")}


def test_empty_split_tables(spark):
    empty = crops(spark, [])
    assert S.conflicting(spark, empty, dev(spark, []), groups(spark).filter("false")).count() == 0
    assert S.assign(spark, empty, dev(spark), groups(spark)).count() == 0


SELECTED = "run_no int, seed long, frac double, drawn_at string, crop_key string"


def test_lost_keys(spark, rows):
    picked = [(1, 7, 0.5, None, "FN-1.jpg"), (2, 7, 0.5, None, "fn_1"), (1, 7, 0.5, None, "fn-2"), (3, 7, 0.5, None, "fn-2 "), (1, 7, 0.5, None, "gone"), (2, 7, 0.5, None, "fn-3"), (3, 7, 0.5, None, "fn-3"), (3, 7, 0.5, None, "fn-4"), (1, 8, 0.5, None, "fn-1"), (1, 7, 0.5, None, None), (None, 7, 0.5, None, "fn-3"), (1, 7, 0.5, None, "fn-2")]
    got = P.lost(spark, spark.createDataFrame(picked, SELECTED), crops(spark, [(f"fn-{i}", "fathomnet", "train", "x") for i in range(1, 6)] * 2))
    assert rows(got, "seed", "crop_key") == [(7, "fn-1"), (7, "fn-2")]
    assert P.lost(spark, spark.createDataFrame([], SELECTED), crops(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_sample_is_stable_and_grows(spark, partitions):
    keys = lambda n: spark.createDataFrame([(f"k{i}",) for i in range(n)], "crop_key string").repartition(partitions)
    none = spark.createDataFrame([], "seed long, crop_key string")
    first = P.draw(spark, keys(1000), none, {1: 0.1, 2: 0.25})
    one = {(r["seed"], r["crop_key"]) for r in first.collect()}
    assert Counter(s for s, _ in one) == {1: 100, 2: 250}
    assert one == {(r["seed"], r["crop_key"]) for r in P.draw(spark, keys(1000).repartition(3), none, {1: 0.1, 2: 0.25}).collect()}
    ledger = spark.createDataFrame(sorted(one), "seed long, crop_key string")
    grown = {(r["seed"], r["crop_key"]) for r in P.draw(spark, keys(3000), ledger, {1: 0.1, 2: 0.25}).collect()}
    assert one <= grown and Counter(s for s, _ in grown) == {1: 300, 2: 750}
    # keys that left are not brought back, kept ones stay beyond the quota
    shrunk = {(r["seed"], r["crop_key"]) for r in P.draw(spark, keys(500), ledger, {1: 0.01, 2: 0.25}).collect()}
    assert {x for x in one if x[0] == 1 and int(x[1][1:]) < 500} <= shrunk


def test_sample_takes_lowest_priorities(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(400)], "crop_key string")
    got = {r["crop_key"] for r in P.draw(spark, keys, spark.createDataFrame([], "seed long, crop_key string"), {5: 0.2}).collect()}
    want = sorted((sha256(f"5:k{i}".encode()).hexdigest()[:15], f"k{i}") for i in range(400))[:80]
    assert got == {k for _, k in want}


def test_current_sample_of_recorded_seeds(spark):
    picked = [(1, 7, 0.5, None, "fn-1"), (2, 7, 0.5, None, "fn-2")]
    got = P.current_sample(spark, spark.createDataFrame(picked, SELECTED), crops(spark, [(f"fn-{i}", "f", "train", "x") for i in range(1, 9)])).collect()
    assert len(got) == 4 and {"fn-1", "fn-2"} <= {r["crop_key"] for r in got if r["kept"]}
    assert P.current_sample(spark, spark.createDataFrame([], SELECTED), crops(spark, [])).count() == 0


def test_ledger_is_kept_from_run_to_run(spark, tmp_path):
    from tidemark.session import Kept

    timed = lambda n: spark.createDataFrame([(f"k{i}", "f", "train", "x", f"2025-01-{1 + i // 100:02d} 00:00:00", "", 1) for i in range(n)], CROPS)
    kept = Kept(spark, f"file://{tmp_path}/ledger")
    first = {(r["seed"], r["crop_key"]) for r in P.next_run(spark, timed(1000), kept, {1: 0.1, 2: 0.3}).collect()}
    # a run that died halfway leaves a version that does not count
    (tmp_path / "ledger" / "v2").mkdir()
    second = P.next_run(spark, timed(2500), kept, {1: 0.1, 2: 0.3}).collect()
    now = {(r["seed"], r["crop_key"]) for r in second}
    assert first <= now and Counter(s for s, _ in now) == {1: 250, 2: 750} and Counter(r["run_no"] for r in second) == {1: 400, 2: 600}
    again = P.next_run(spark, timed(2500), kept, {1: 0.1, 2: 0.3})
    assert {(r["seed"], r["crop_key"]) for r in again.collect()} == now and kept.versions() == [1, 2, 3]


def test_cut_that_held_too_few_is_raised(spark, monkeypatch):
    """Keys that all have high priorities: the first cuts hold none of them."""
    high = sorted((f"k{i}" for i in range(4000)), key=lambda k: sha256(f"9:{k}".encode()).hexdigest())[-200:]
    keys = spark.createDataFrame([(k,) for k in high], "crop_key string")
    got = {r["crop_key"] for r in P.draw(spark, keys, spark.createDataFrame([], "seed long, crop_key string"), {9: 0.1}).collect()}
    assert got == set(high[:20])
