"""Queries against brute force on tables where a query that leaves out rows, tries or draws gives less."""

import datetime
import hashlib

from tidemark.plans.catalogue import QUERIES


def lineitem(spark, path, rows):
    """Writes a lineitem table of (order, part, supplier, quantity)."""
    full = [(o, p, s, i % 7 + 1, float(q), 100.0 + i, datetime.date(1995, 1, 1), "NAR"[i % 3], "FO"[i % 2]) for i, (o, p, s, q) in enumerate(rows)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate date, l_returnflag string, l_linestatus string"
    spark.createDataFrame(full, names).write.parquet(f"{path}/lineitem.parquet")


def test_token_components_use_every_order(spark, tmp_path):
    orders = [(k, (k * 7) % 90 + 1) for k in range(1, 160)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for key, customer in orders:
        a, b = f"t{customer}", f"t{customer // 4 * 4 + key % 3}"
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["v"]: r["root"] for r in QUERIES["token_components"](spark, str(tmp_path)).collect()}
    assert got == {v: find(v) for v in root}


def test_place_backgrounds_use_sixty_tries(spark, tmp_path):
    frames, places = [1000 * i + 150 for i in range(40)], (0, 900, 1799)
    boxes = [(x, f, 1, 100) for f in frames for x in places]  # a band that leaves little room above and below
    lineitem(spark, tmp_path, boxes)

    def uniform(what):
        return int(hashlib.sha256(f"bg:{what}".encode()).hexdigest()[:8], 16) / 4294967296.0

    want, late = {}, 0
    for i, f in enumerate(frames):
        w, h = [(200, 150), (600, 400), (64, 64)][int(uniform(f"size:{f}") * 3)]
        own = [(x, 150, 1008, 708 + (i * len(places) + j) % 7 + 1) for j, x in enumerate(places)]
        for t in range(60):
            x, y = int(uniform(f"x:{t}:{f}") * (1921 - w)), int(uniform(f"y:{t}:{f}") * (1081 - h))
            if not any(x < a + c + 8 and a - 8 < x + w and y < b + d + 8 and b - 8 < y + h for a, b, c, d in own):
                want[f], late = (w, h, x, y), late + (t >= 8)
                break
    got = {r["frame"]: (r["w"], r["h"], r["x"], r["y"]) for r in QUERIES["place_backgrounds"](spark, str(tmp_path)).collect()}
    assert late > 0 and got == want


def test_draws_go_on_until_a_try_fits(spark, tmp_path):
    heavy = {s: {1: 25} | {d: 1 for d in range(2, 12)} for s in range(1, 9)}  # fits only when the heavy deployment comes first
    sizes = heavy | {20: {1: 15, 2: 15}, 21: {1: 12, 2: 12, 3: 12}, 22: {1: 5}}  # never fits, always fits, not usable
    lineitem(spark, tmp_path, [(1000 * s + 50 * d + i, s, d, 1) for s, own in sizes.items() for d, n in own.items() for i in range(n)])
    want = {}
    for s, own in sizes.items():
        for draw in range(10):
            for t in range(1000):
                order = sorted(own, key=lambda d: hashlib.sha256(f"w:{draw}:{t}:{s}:{d}".encode()).hexdigest())
                refs = []
                while sum(own[d] for d in refs) < 20 and len(refs) < len(order):
                    refs.append(order[len(refs)])
                if sum(own[d] for d in refs) >= 20 and sum(own.values()) - sum(own[d] for d in refs) >= 10:
                    want[draw, s] = (t, frozenset(refs), sum(own.values()) - sum(own[d] for d in refs))
                    break
    made = QUERIES["make_draws"](spark, str(tmp_path)).collect()
    got = {}
    for pair in {(r["draw"], r["species"]) for r in made}:
        own = [r for r in made if (r["draw"], r["species"]) == pair]
        refs = [r for r in own if r["role"] == "reference"]
        assert sorted(r["ref_rank"] for r in refs) == list(range(1, 21))
        apart = {r["deployment"] for r in refs}, {r["deployment"] for r in own if r["role"] == "query"}
        assert not apart[0] & apart[1]
        got[pair] = ({r["try_no"] for r in own}, set(sizes[pair[1]]) - apart[1], len(own) - len(refs))
    assert max(t for t, *_ in want.values()) >= 4 and {s for _, s in want} == {*heavy, 21} and len(want) == 90
    assert got == {pair: ({t}, set(refs), n) for pair, (t, refs, n) in want.items()}
    assert QUERIES["draws_disjoint"](spark, str(tmp_path)).head()["shared"] == 0
    assert [tuple(r) for r in QUERIES["draws_failed"](spark, str(tmp_path)).collect()] == [(20, 10)]


def test_offset_search_asks_for_every_click(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(i, i % 7, ("click", "view", "error")[i % 3], start + datetime.timedelta(hours=i * 5 % 83)) for i in range(1, 200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    hour = {i: (t - start) // datetime.timedelta(hours=1) for i, _, _, t in events}
    want = {}
    for i, user, kind, _ in events:
        near = [(abs(hour[j] - hour[i]), hour[j] - hour[i], "LR"[j % 2]) for j, u, k, _ in events if k != "click" and u == user and abs(hour[j] - hour[i]) <= 6]
        if kind == "click" and near:
            want[i] = min(near)[1:]
    assert {i % 10 for i in want} == set(range(10))
    assert {r["i"]: (r["delta"], r["camera"]) for r in QUERIES["offset_search"](spark, str(tmp_path)).collect()} == want
