import random

import pytest

from tidemark.llm import matching as M


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def random_edges(seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(1060, 1000)] if seed % 2 else [(i, i + 1) for i in range(1000, 1060)]
    edges += [(1, 100 + i) for i in range(80)]  # a star: one vertex with most rows
    edges += [(rng.randint(200, 240), rng.randint(200, 240)) for _ in range(70)]  # a core
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(45)]  # trees and pairs
    edges += [(None, 5), (5, None), (7, 7)]
    edges += edges[:30] + [(b, a) for a, b in edges[:20]]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("seed, rounds", [(1, 12), (2, 3), (3, 0)])
def test_groups_equal_union_find(spark, seed, rounds):
    edges = random_edges(seed)
    got = {r["v"]: r["root"] for r in M.grouped(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    assert got == brute(edges)


def test_removed_vertices_are_independent(spark):
    edges = spark.createDataFrame([(a, b) for a, b in brute_edges()], "a long, b long")
    gone = {r["v"] for r in M.removable(edges, 0).collect()}
    assert gone and not any(a in gone and b in gone for a, b in brute_edges())


def brute_edges():
    return [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100)]


def test_image_groups(spark, rows):
    images = [(i, f"https://h.example/f%20g/{i}.png", "inst", None) for i in range(1, 9)]
    images += [images[0], (None, "https://h.example/f%20g/99.png", None, None), (50, None, None, None)]
    u = lambda i: f"https://h.example/f%20g/{i}.png"
    matches = [(1, u(3), u(2)), (2, u(2).upper().replace("F%20G", "f g").replace("PNG", "png").replace("HTTPS", "http"), u(3)), (3, u(4), "https://h.example/ghost"), (4, "https://H.example/ghost ", u(5)), (5, u(6), None), (6, None, u(6)), (7, u(7), u(7)), (8, u(8), "https://h.example/alone")]
    got = M.image_groups(spark, spark.createDataFrame(images, "image_id long, frame_url string, owner_institution string, group_id long"), spark.createDataFrame(matches, "match_id long, frame_url_a string, frame_url_b string"))
    assert rows(got, "image_id", "group_id") == [(2, 2), (3, 2), (4, 4), (5, 4)]


def test_empty(spark):
    images = spark.createDataFrame([], "image_id long, frame_url string")
    assert M.image_groups(spark, images, spark.createDataFrame([], "frame_url_a string, frame_url_b string")).count() == 0


def test_hub_of_short_and_long_spokes(spark, rows):
    """A hub whose leaves and spokes leave in different rounds; it has no label of its own until they are restored."""
    edges = [(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(1, 200)] + [(1000 + i, 2000 + i) for i in range(1, 100)]
    got = rows(M.grouped(spark.createDataFrame(edges, "a long, b long")), "v", "root")
    assert got == sorted((v, 0) for v in {x for e in edges for x in e})
