import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, graph, integrity, joins, links, metadata, resolve, sampling, shards, units, vectors


def test_components_of_chains_cycles_and_loops(spark, rows):
    edges = [(i, i + 1) for i in range(1, 300)] + [(400, 401), (401, 402), (402, 400), (500, 500), (None, 3), (7, None), (401, 400)]
    random.Random(1).shuffle(edges)
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "v", "root"))
    assert {got[i] for i in range(1, 301)} == {1} and {got[i] for i in (400, 401, 402)} == {400} and 500 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [100, 1])
def test_lookup_join_both_ways(spark, rows, limit):
    big = spark.createDataFrame([(i % 3, i) for i in range(60)], "k long, i long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, t string")
    assert joins.lookup_join(big, small, ["k"], limit=limit).count() == 40
    assert joins.lookup_join(big, small, ["k"], "left", limit=limit).filter("t is null").count() == 20
    assert joins.lookup_join(big, small, ["k"], "left_anti", limit=limit).count() == 20


def joined(df):
    """Rows of df, and whether a part of its final plan was broadcast."""
    got = df.collect()
    return got, "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how, n", [("inner", 40), ("left", 60), ("left_semi", 40), ("left_anti", 20)])
def test_salted_lookup_is_not_broadcast(spark, how, n):
    big, small = spark.range(60).selectExpr("id % 3 AS k", "id AS i"), spark.range(2).selectExpr("id AS k", "'t' AS t")
    for own, many in ((small, False), (small.filter("k >= 0"), False), (small, True)):  # a size that is known, one that is estimated, one that was measured
        got, sent = joined(joins.lookup_join(big, own.repartition(2) if many else own, ["k"], how, limit=1))
        assert len(got) == n and not sent


def test_details_of_many_videos_are_not_broadcast(spark):
    crops, videos = spark.range(300_000).selectExpr("id AS crop", "id % 150000 AS video"), spark.range(120_000).selectExpr("id AS video", "concat('h', id) AS habitat")
    both, review = metadata.with_details(crops, videos, ["video"], "no video", F.col("crop"))
    got, sent = joined(review)
    assert {r["item"] for r in got} == {str(i) for i in range(300_000) if i % 150_000 >= 120_000} and len(got) == 60_000 and not sent
    assert both.count() == 300_000


def test_actions_of_many_concepts_are_not_broadcast(spark):
    concepts = spark.range(120_000).selectExpr("id AS concept", "CASE WHEN id % 3 = 0 THEN 'class' WHEN id % 3 = 1 THEN 'unlabelled' ELSE 'drop' END AS action")
    boxes = spark.range(300_000).selectExpr("id % 150000 AS c", "id % 1000 AS image")  # the last 30,000 concepts are not in the map
    got, sent = joined(metadata.image_actions(metadata.concept_actions(boxes, concepts, "c"), "image"))
    want = {i: [0, 0, 0, 0] for i in range(1000)}
    for i in range(300_000):
        own, c = want[i % 1000], i % 150_000
        own[0] += 1
        own[c % 3 + 1 if c < 120_000 else 3] += 1
    assert {r["image"]: (r["boxes"], r["unlabelled"], r["dropped"], r["usable"]) for r in got} == {i: (n, u, d, k > 0) for i, (n, k, u, d) in want.items()} and not sent


def test_lineage_of_many_categories_is_not_broadcast(spark):
    annotations = spark.range(300_000).selectExpr("id AS annotation_id", "id % 150000 AS category_id")
    categories = spark.range(120_000).selectExpr("id AS category_id", "concat('f', id % 10) AS family", "concat('g', id) AS genus")
    got, sent = joined(metadata.with_lineage(annotations, categories))
    assert {(r["annotation_id"], r["family"], r["genus"]) for r in got} == {(i, f"f{i % 150_000 % 10}", f"g{i % 150_000}") for i in range(300_000) if i % 150_000 < 120_000} and len(got) == 240_000 and not sent


def tracks(spark):
    boxes = [("V1", 1, 10, 100, 100, 50, 50), ("V1", 1, 11, 102, 101, 50, 50), ("V1", 1, 12, 104, 103, 50, 50), ("V1", 1, 10, 500, 400, 40, 40), ("V1", 1, 11, 503, 402, 40, 40), ("V1", 2, 50, 10, 10, 20, 20), ("V2", 1, 1, 0, 0, 30, 30), ("V2", 1, 5, 1, 1, 30, 30)]
    return spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "ident long, video string, taxon long, frame long, x long, y long, w long, h long")


@pytest.mark.parametrize("window, threshold, n", [(2, 0.3, 5), (5, 0.3, 4), (2, 0.99, 8)])
def test_range_tracks(spark, window, threshold, n):
    got = links.range_tracks(tracks(spark), ["video", "taxon"], "frame", "ident", window, ("x", "y", "w", "h"), threshold)
    assert got.select("track").distinct().count() == n and got.count() == 8
    s = links.track_summary(got, 0.5).head()
    assert s["tracks"] == n and s["crops"] == 8


def test_same_frame_never_links(spark):
    df = spark.createDataFrame([(1, "v", 1, 5, 0, 0, 9, 9), (2, "v", 1, 5, 0, 0, 9, 9)], tracks(spark).schema)
    assert links.range_tracks(df, ["video", "taxon"], "frame", "ident", 5, ("x", "y", "w", "h"), 0).select("track").distinct().count() == 2


def test_islands_and_shuffle(spark, rows):
    df = tracks(spark).select("ident", "video", "frame")
    got = links.islands(df, ["video"], "frame", 5)
    assert got.filter("video = 'V1'").select("track").distinct().count() == 2
    mixed = links.shuffled_within(df, ["video"], ["frame"], "ident", 1)
    assert rows(mixed, "video", "frame") == rows(df, "video", "frame")


def test_stereo_offset_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("d", "t", 10, "L"), ("d", "t", 13, "R"), ("d", "t", 7, "R")], "dep string, tax string, frame long, cam string")
    assert links.stereo_offset(df, "dep", "tax", "frame", "cam", 100).head()["delta"] == -3


def test_grid_sites_against_all_pairs(spark, rows):
    from math import asin, cos, radians, sin, sqrt

    rng = random.Random(3)
    points = [(i, rng.uniform(-80, 80), rng.uniform(-170, 170)) for i in range(40)]
    points += [(100 + i, a + rng.uniform(-0.02, 0.02), o + rng.uniform(-0.05, 0.05)) for i, a, o in points for _ in (0,)]
    km = lambda p, q: 2 * 6371 * asin(sqrt(sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2))
    want = {p[0]: min(q[0] for q in points if km(p, q) <= 3) for p in points}
    got = dict(rows(links.grid_sites(spark.createDataFrame(points, "i long, la double, lo double"), "i", "la", "lo", 3.0), "i", "site"))
    assert {i for i in want if want[i] != i} <= {i for i in got if got[i] != i}
    assert all(km(next(p for p in points if p[0] == i), next(p for p in points if p[0] == s)) <= 12 for i, s in got.items())


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, at long, i long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, at long, v long")
    got = {r["i"]: r["v"] for r in links.nearest_before(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {1: 50, 2: None, 3: None}


def test_units_and_gates(spark, rows):
    data = [("s1", "g", d) for d in "aaabbbcc"] + [("s2", "g", d) for d in "aaaaaaab"] + [("s3", "h", d) for d in "ab"]
    df = spark.createDataFrame(data, "species string, genus string, dep string")
    assert rows(units.usable(df, "species", "dep", 4, 3), "species", "largest") == [("s1", 3)]
    sweep = {(r["min_crops"], r["min_groups"]): r for r in units.gate_sweep(df, "species", "genus", "dep", [2, 8], [0, 3]).collect()}
    assert sweep[2, 0]["species"] == 3 and sweep[2, 0]["genera2"] == 1 and sweep[8, 3]["species"] == 1
    assert units.gate_sweep(df.filter("false"), "species", "genus", "dep", [2], [0]).count() == 0


def test_upsert_is_idempotent(spark):
    held = spark.createDataFrame([("a", 5), ("b", 7)], "k string, id long")
    new = spark.createDataFrame([("b", None), ("c", None), ("d", None), ("d", None)], "k string, id long")
    once = integrity.upsert(held, new, "k", "id")
    assert sorted(r["id"] for r in once.collect()) == [5, 7, 8, 9]
    assert sorted(map(tuple, integrity.upsert(once, new, "k", "id").collect())) == sorted(map(tuple, once.collect()))


def test_draws_are_nested_and_disjoint(spark):
    df = spark.createDataFrame([("s", f"d{i % 7}", f"k{i}") for i in range(60)], "sp string, dep string, key string")
    small, large = (sampling.draws(df, "sp", "dep", "key", k, 10, 2, 5, "w") for k in (5, 20))
    for d in (small, large):
        sides = d.groupBy("draw", "dep").agg(F.count_distinct("role").alias("r"))
        assert sides.filter("r > 1").count() == 0
        assert d.filter("role = 'query'").groupBy("draw").count().filter("count < 10").count() == 0
    assert large.filter("role = 'reference'").groupBy("draw").count().filter("count <> 20").count() == 0


def test_samples_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(f"g{i % 3}", f"k{i}") for i in range(100)], "g string, key string")
    a, b = sampling.stratified(df.repartition(1), ["g"], "key", 0.3, "x"), sampling.stratified(df.repartition(7), ["g"], "key", 0.3, "x")
    assert rows(a, "key") == rows(b, "key") and a.count() == 30


def test_match_shape_equalises_bins(spark):
    df = spark.createDataFrame([("a", i % 4, f"a{i}") for i in range(200)] + [("b", i % 2, f"b{i}") for i in range(90)], "side string, bin0 int, key string")
    got = sampling.match_shape(df, "side", "a", "b", F.col("bin0"), "key", "s")
    share = {(r["side"], r["bin"]): r["count"] for r in got.groupBy("side", "bin").count().collect()}
    assert set(share) == {("a", 0), ("a", 1), ("b", 0), ("b", 1)} and share["a", 0] == share["a", 1] and share["b", 0] == share["b", 1]


def test_quota_greedy(spark):
    df = spark.createDataFrame([(1, "common"), (2, "common"), (3, "common"), (3, "rare")], "image long, concept string")
    assert {r["image"]: r["kept"] for r in sampling.quota_greedy(df, "image", "concept", 2).collect()} == {3: True, 1: True, 2: False}


def test_greedy_shards(spark):
    df = spark.createDataFrame([("s", i, 40) for i in range(6)] + [("t", 1, None)], "src string, i long, size long")
    got = sorted((r["src"], r["i"], r["shard"]) for r in shards.greedy_shards(df, "src", "i", "size", 100).collect())
    assert [x[2] for x in got] == [0, 0, 0, 1, 1, 1, 0]


def test_resolve_accepted(spark):
    edges = [(1, 1, "accepted"), (2, 1, "unaccepted"), (3, 2, "unaccepted"), (4, 5, "u"), (5, 4, "u"), (6, None, "nomen dubium"), (7, 99, "u"), (8, 6, "u"), (20, 9, "Nomen dubium "), (9, 9, "accepted"), (21, 9, "accepted"), (22, 22, "unaccepted"), (23, 0, None), (24, 20, "u"), (50, 6, "unaccepted"), (None, 1, "u"), (2, 1, "unaccepted")]
    edges += [(30 + i, 31 + i, "u") for i in range(8)] + [(38, None, "accepted")]
    records = spark.createDataFrame(edges, "id long, valid long, status string")
    got = {r["id"]: (r["final"], r["outcome"]) for r in resolve.resolve_accepted(records).collect()}
    want = {1: (1, "accepted"), 2: (1, "remapped"), 3: (1, "remapped"), 4: (None, "review"), 5: (None, "review"), 6: (6, "kept"), 7: (None, "review"), 8: (8, "kept"), 20: (None, "review"), 9: (9, "accepted"), 21: (21, "accepted"), 22: (22, "kept"), 23: (23, "kept"), 24: (9, "remapped"), 50: (50, "kept")}
    want |= {30 + i: (None, "review") for i in range(4)} | {34 + i: (38, "remapped") for i in range(4)} | {38: (38, "accepted")}
    assert got == want
    taxa = spark.createDataFrame([("a", 1), ("b", 2), ("c", 6), ("d", 20), ("e", None), ("f", 0), ("g", 777)], "key string, aphia_id long")
    mapped = resolve.resolve_map(taxa, records)
    assert {r["key"]: (r["resolved"], r["outcome"]) for r in mapped.collect()} == {"a": (1, "accepted"), "b": (1, "remapped"), "c": (6, "kept"), "d": (None, "review"), "e": (None, "none"), "f": (0, "none"), "g": (None, "review")}
    assert {(r["key"], r["status"]) for r in resolve.changes(mapped).collect()} == {("b", "unaccepted"), ("c", "nomen dubium (kept)")}
    assert {r["key"] for r in resolve.for_review(mapped).collect()} == {"d", "g"}
    assert [tuple(r) for r in resolve.merges(mapped, "resolved").collect()] == [(1, 2)]
    present = spark.createDataFrame([(i,) for i in (1, 2, 20, 24, 8, 50, 21, 777, 35)], "id long")
    assert {r["id"]: r["action"] for r in resolve.audit_chains(present, records).collect()} == {1: "ok", 2: "merge", 20: "review", 24: "review", 8: "review", 50: "rename", 21: "ok", 777: "review", 35: "review"}
    assert resolve.resolve_accepted(spark.createDataFrame([], "id long, valid long, status string")).count() == 0


def test_by_name(spark):
    rows = [(1, 1, "accepted", "Aa", "Aa", "Genus"), (2, 1, "unaccepted", "Ab", "Aa", "Genus"), (3, 3, "accepted", "Twin", "Twin", "Genus"), (4, 4, "accepted", "Twin", "Twin", "Genus"), (5, 1, "unaccepted", "Aa", "Aa", "Genus"), (6, 1, "uncertain", "Odd", "Aa", "Genus")]
    records = spark.createDataFrame(rows, "id long, valid long, status string, name string, valid_name string, taxon_rank string")
    names = spark.createDataFrame([(" Aa",), ("Ab",), ("Twin",), ("Odd",), ("none",), (None,), ("",)], "name string")
    assert {r["name"]: r["final"] for r in resolve.by_name(names, records).collect()} == {"Aa": 1, "Ab": 1, "Twin": None, "Odd": None, "none": None}


def test_greedy_cover_ties(spark):
    counts = spark.createDataFrame([("b", "x", 3), ("a", "x", 3), ("c", "y", 1)], "group string, taxon string, units long")
    assert resolve.greedy_cover(counts, 2, 5) == [("a", 2), ("c", 1)]


def test_prototypes_and_recall(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [3.0, 0.3]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 0.0])], "id long, label int, v array<double>")
    p = vectors.prototypes(df, "label", "v")
    got = vectors.predictions(df, p, "id", "label", "v")
    assert {r["id"]: r["predicted"] for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
    assert vectors.macro_recall(got, "label").head()["macro_recall"] == 0.75


def test_leakage_equals_all_pairs(spark):
    rng = random.Random(2)
    data = [(i, i % 3, i % 4, [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    got = vectors.leakage(spark.createDataFrame(data, "id long, sp long, dep long, v array<double>"), "sp", "dep", "v").head()

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    u = [(s, d, unit(v)) for _, s, d, v in data]

    def side(a, b):
        top = low = 0.0
        for g in {x[a] for x in u}:
            pairs = [(x, y) for i, x in enumerate(u) for y in u[i + 1 :] if x[a] == y[a] == g]
            ok = [(x, y) for x, y in pairs if x[b] != y[b]]
            top += sum(sum(p * q for p, q in zip(x[2], y[2])) for x, y in ok) / len(pairs)
            low += len(ok) / len(pairs)
        return top / low

    assert got["same_species"] == pytest.approx(side(0, 1), abs=1e-6) and got["same_group"] == pytest.approx(side(1, 0), abs=1e-6)


def test_decide_with_equal_candidates(spark):
    df = spark.createDataFrame([("l", c, d, v) for d in range(4) for c, v in (("a", 0.5), ("b", 0.5), ("c", 0.1 + d / 100))], "level string, cand string, draw int, v double")
    got = {r["cand"]: (r["best"], r["tied"]) for r in decisions.decide(df, "level", "cand", "draw", "v", 2.35).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", False)}


def test_places_of_hot_groups(spark, rows, monkeypatch):
    from tidemark.operators import ranks

    data = [(g, i * 7919 % 1000, i) for g, n in (("hot", 600), ("b", 30), (None, 50), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    plain = rows(ranks.placed(df, ["g"], ["v", "i"]).filter("g is not null"), "g", "i", "rn")
    null = sorted((r["v"], r["i"], r["rn"]) for r in ranks.placed(df, ["g"], ["v", "i"]).filter("g is null").collect())
    monkeypatch.setattr(ranks, "GROUP_ROWS", 40)
    assert rows(ranks.placed(df, ["g"], ["v", "i"]).filter("g is not null"), "g", "i", "rn") == plain
    assert sorted((r["v"], r["i"], r["rn"]) for r in ranks.placed(df, ["g"], ["v", "i"]).filter("g is null").collect()) == null
    assert [r["code"] for r in integrity.dense_codes(df, "i").orderBy("i").collect()] == list(range(600))
    every = sampling.stride(df.filter("g = 'hot'"), ["g"], ["v", "i"], 50)
    assert every.count() == 12 and sampling.stratified(df, ["g"], "i", 0.1, "s").groupBy("g").count().filter("g = 'hot'").head()["count"] == 60


def test_dense_sites(spark, rows):
    """Thousands of points in a few cells, chains across cells, and gaps that only inner points close."""
    import math

    rng = random.Random(5)
    points = [(i, 10 + rng.random() * 0.02, 20 + rng.random() * 0.02) for i in range(400)]
    points += [(1000 + i, 60 + i * 0.02, -30.0) for i in range(20)] + [(2000 + i, -75 + rng.random(), 100 + 3 * rng.random()) for i in range(150)]
    points += [(3000, 0.0, 0.0), (3001, 0.0, 0.0), (3002, None, 1.0), (3003, 0.0, float("nan"))]
    root = {i: i for i, *_ in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    real = [x for x in points if x[1] is not None and x[2] == x[2]]
    for i, a in enumerate(real):
        for b in real[:i]:
            if km(a, b) <= 3.0:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    got = dict(rows(links.grid_sites(spark.createDataFrame(points, "i long, la double, lo double"), "i", "la", "lo", 3.0), "i", "site"))
    assert got == {i: find(i) for i in root}


def test_date_links_join_what_all_pairs_would(spark, rows):
    from tidemark.operators import groups

    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.randint(1, 6), f"t{rng.randint(1, 40)}", rng.random() < 0.4) for _ in range(120)] + [("a", None, "t1", True), (None, 1, "t2", False), ("b", 2, None, True)]

    def joined(pairs):
        root = {}
        find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {v: find(v) for v in root}

    want = joined((a[2], b[2]) for a in data for b in data if a[:2] == b[:2] and None not in a[:3] + b[:3] and not a[3] and b[3] and a[2] != b[2])
    got = joined((r["a"], r["b"]) for r in groups.date_links(spark.createDataFrame(data, "s string, d int, t string, ok boolean"), "s", "d", "t", "ok").collect())
    assert got == want


def test_predictions_in_blocks(spark, rows, monkeypatch):
    rng = random.Random(1)
    protos = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "label int, v array<double>")
    made = vectors.prototypes(protos, "label", "v")
    queries = spark.createDataFrame([(i, rng.randint(0, 29), [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(900, 1, None), (901, 2, [0.0] * 4)], "id long, label int, v array<double>")
    parents = spark.createDataFrame([(i, i // 7) for i in range(30)], "label int, parent int")
    for own in (None, parents):
        whole = rows(vectors.predictions(queries, made, "id", "label", "v", own), "id", "label", "predicted")
        with monkeypatch.context() as m:
            m.setattr(vectors, "BLOCK_BYTES", 8 * 4 * 9)
            assert rows(vectors.predictions(queries, made, "id", "label", "v", own), "id", "label", "predicted") == whole
        assert 195 < len(whole) <= 201
    assert vectors.predictions(queries, made.filter("false"), "id", "label", "v").count() == 0


def test_totals_and_percentiles_by_ranges(spark, rows, monkeypatch):
    from tidemark.operators import ranks

    rng = random.Random(4)
    data = [(g, rng.randint(0, 40), i) for g, n in (("a", 300), ("b", 7), ("c", 1), (None, 20)) for i in range(n)] + [("a", None, 999), ("d", None, 1000)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(4)
    key = lambda r: (str(r["g"]), r["i"])

    def totals():
        return {key(r): r["t"] for r in ranks.total_before(df, ["g"], ["i"], F.col("v"), "t").collect()}

    want = {}
    for g in {x[0] for x in data}:
        run = 0
        for _, v, i in sorted((x for x in data if x[0] == g), key=lambda x: x[2]):
            want[str(g), i] = run
            run += v or 0
    exact = {str(r["g"]): r["p"] for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("p")).collect() if r["p"] is not None}
    mine = lambda: {str(r["g"]): r["p"] for r in ranks.percentile(df, ["g"], "v", 0.3, "p").collect()}
    assert totals() == want and mine() == pytest.approx(exact)
    monkeypatch.setattr(ranks, "GROUP_ROWS", 20)
    monkeypatch.setattr(ranks, "RANGE_ROWS", 16)
    assert totals() == want and mine() == pytest.approx(exact)
