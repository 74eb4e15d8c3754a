import numpy as np

from tidemark.llm import neighbours as N
from tidemark.llm.vamana import Graph

SCHEMA = "readout_id long, backbone string, layer string, cls array<float>, patch_mean array<float>, near long, sim double"


def clustered(n, d=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n - 3, 10):  # planted close groups
        x[i + 1], x[i + 2] = x[i] + 0.1 * rng.normal(size=d), x[i] + 0.15 * rng.normal(size=d)
    return x


def table(spark, x, backbone="murk-so400", layer="1"):
    return spark.createDataFrame([(i, backbone, layer, None, [float(v) for v in row], 0, 0.0) for i, row in enumerate(x)], SCHEMA)


def nearest(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, 1)[:, :k], s


def test_graph_recall_and_out_degree():
    x = clustered(1500)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = Graph(u)
    assert (g.links >= 0).sum(1).max() <= g.degree and not (g.links == np.arange(len(u))[:, None]).any()
    found, sims = g.search(u, 64)
    assert (found[:, 0] == np.arange(len(u))).mean() > 0.999 and (np.diff(sims, axis=1) <= 0).all()
    want, _ = nearest(x, 5)
    assert np.mean([len(set(a[1:6]) & set(b)) / 5 for a, b in zip(found, want)]) > 0.9
    assert Graph(np.empty((0, 4), np.float32)).search(np.zeros((2, 4), np.float32), 3)[0].tolist() == [[-1] * 3] * 2
    assert Graph(u[:1]).search(u[:2], 3)[0][0].tolist() == [0, -1, -1]


def test_all_cells_reach_the_stated_recall(spark):
    x = clustered(1200, seed=2)
    units = N.unit_vectors(table(spark, x))
    asked = spark.createDataFrame([(i,) for i in range(0, 1200, 50)], "id long")
    got: dict = {}
    for r in N.similar(spark, units, queries=asked, probes=None, beam=N.WIDE_BEAM, shard=256).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    want, _ = nearest(x, 5)
    assert set(got) == set(range(0, 1200, 50)) and np.mean([len(got[i] & set(want[i])) / 5 for i in got]) >= 0.9


def test_close_pairs_equal_brute_force(spark, rows):
    x = clustered(1500, seed=3)
    want, s = nearest(x, 5)
    pairs = {(a, int(b)) for a in range(len(x)) for b in want[a] if a < b and a in want[b] and s[a, b] >= 0.9}
    got = set(rows(N.close_pairs(spark, table(spark, x)), "readout_id_a", "readout_id_b"))
    assert got <= pairs and len(got) >= 0.97 * len(pairs) and len(pairs) > 200


def test_unusable_rows_and_groups(spark, rows):
    v, w = [1.0, 0.0], [0.6, 0.8]
    nan, inf = float("nan"), float("inf")
    data = [
        (1, "b", "1", v, w, 0, 0.0), (2, "b", "1", [5.0, 0.0], [0.3, 0.4], 0, 0.0), (3, "b", "2", v, w, 0, 0.0), (4, "b", "1", None, w, 0, 0.0), (5, "b", "1", v, None, 0, 0.0), (6, "b", "1", [0.0, 0.0], w, 0, 0.0), (7, "b", "1", [nan, 1.0], w, 0, 0.0),
        (8, "b", "1", [None, 1.0], w, 0, 0.0), (9, "b", "1", [inf, 1.0], w, 0, 0.0), (10, "murk-so400", "1", None, v, 0, 0.0), (11, "murk-so400", "1", None, v, 0, 0.0), (None, "b", "1", v, w, 0, 0.0), (1, "b", "1", v, w, 0, 0.0), (12, "b", "1", [], [], 0, 0.0), (13, "b", "1", v, [1.0], 0, 0.0),
    ]
    got = rows(N.close_pairs(spark, spark.createDataFrame(data, SCHEMA)), "readout_id_a", "readout_id_b")
    assert got == [(1, 2), (10, 11)]


def test_a_third_of_all_rows_are_copies(spark):
    x = clustered(300, seed=4)
    x[:100] = x[0]
    got = N.similar(spark, N.unit_vectors(table(spark, x))).collect()
    near: dict = {}
    for r in got:
        near.setdefault(r["id"], []).append((r["sim"], r["neighbour"]))
    assert set(near) == set(range(300)) and all(len(v) == 5 for v in near.values())
    assert sorted(n for _, n in near[50]) == [0, 1, 2, 3, 4] and sorted(n for _, n in near[2]) == [0, 1, 3, 4, 5]


def test_hot_cells_are_split(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    x = centre + 0.02 * rng.normal(size=(400, 16))  # all in one place
    want, _ = nearest(x, 5)
    got: dict = {}
    for r in N.similar(spark, N.unit_vectors(table(spark, x)), shard=100, largest=50).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in range(400)]) > 0.9


def test_every_row_reaches_the_recall_over_many_cells(spark):
    """No structure, 40 cells: the number of cells to search is measured, not fixed."""
    x = np.random.default_rng(8).normal(size=(2000, 16))
    units = N.unit_vectors(table(spark, x)).cache()
    found = N.similar(spark, units, shard=50, beam=32).cache()
    want, _ = nearest(x, 5)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    true = np.mean([len(got[i] & set(want[i])) / 5 for i in range(2000)])
    measured = N.recall(spark, units, found, units.select("id")).collect()
    assert true >= 0.9 and [r["asked"] for r in measured] == [2000] and abs(measured[0]["recall"] - true) < 1e-3


def test_more_probes_where_neighbours_are_farther():
    x = np.random.default_rng(9).normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = N.fit_centres(x, 60)
    few, more, most = (N.needed_probes(x, centres, least, 5) for least in (0.98, 0.9, -2.0))
    assert 1 <= few < more < most <= 60
    assert N.fit_centres(x, 300).shape[0] <= 300 and N.needed_probes(x, centres[:1], 0.9, 5) == 1


def test_empty(spark):
    assert N.close_pairs(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.similar(spark, N.unit_vectors(table(spark, clustered(1)))).count() == 0
