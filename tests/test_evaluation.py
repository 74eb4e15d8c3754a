from collections import Counter, defaultdict
from hashlib import sha256

from tidemark.operators import evaluation, frames, resolve


def test_stepped_draws_take_the_largest_k_that_fits(spark):
    sizes = {"big": {f"d{i}": 12 for i in range(10)}, "mid": {"d1": 9, "d2": 9, "d3": 9}, "small": {"d1": 3, "d2": 2}, "alone": {"d1": 80}, "poor": {f"d{i}": 12 for i in range(10)}}
    rows = [(t, g, f"{t}-{g}-{i}") for t, own in sizes.items() for g, n in own.items() for i in range(n)] + [(None, "d1", "x"), ("mid", None, "nogroup")]
    other = [(t, f"r{i % 4}", f"ref-{t}-{i}") for t in ("big", "mid", "small", "alone") for i in range(60)] + [("poor", "r0", f"ref-poor-{i}") for i in range(60)]
    df = lambda data: spark.createDataFrame(data, "taxon string, grp string, key string")
    got = evaluation.stepped_draws(df(rows), df(other), "taxon", "grp", "key", [5, 10, 50], 8, 2).collect()
    k = {r["taxon"]: r["k"] for r in got}
    # mid: 10 rows need two groups, which leaves 9 or 10 queries; poor: its references lie in one group
    assert k == {"big": 50, "mid": 10}
    group = {key: g for _, g, key in rows}
    sides = defaultdict(set)
    for r in got:
        if r["role"] != "cross":
            sides[r["taxon"], r["role"]].add(group[r["key"]])
    for t in k:
        n = Counter(r["role"] for r in got if r["taxon"] == t)
        assert n["base"] == n["cross"] == k[t] and n["query"] >= 8 and not sides[t, "base"] & sides[t, "query"]
    again = evaluation.stepped_draws(df(rows).repartition(5), df(other).repartition(3), "taxon", "grp", "key", [5, 10, 50], 8, 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def greedy(counts, stages, picks, need, protected, bar=None):
    """The cover by plain loops."""
    units = defaultdict(dict)
    for s, g, t, u in counts:
        units[s, g][t] = units[s, g].get(t, 0) + u
    out, taken = [], []
    totals = lambda keys: {t: (sum(units[k].get(t, 0) for k in keys), sum(1 for k in keys if units[k].get(t, 0))) for k in keys for t in units[k]}
    start = totals(list(units))
    for number, stage in enumerate(stages):
        while sum(s == stage for s, *_ in out) < picks[stage]:
            rest = [k for k in units if k not in taken]
            left = totals(rest)
            best = None
            for key in sorted(k for k in rest if k[0] == stage):
                have = totals([k for k in taken if number or k[0] == stage])
                gain = sum(max(0, min(u, need - have.get(t, (0, 0))[0])) for t, u in units[key].items())
                bad = any(start[t][0] >= a and start[t][1] >= b and (left[t][0] - u < a or left[t][1] - 1 < b) for t, u in units[key].items() for a, b in protected)
                if gain > 0 and not bad and (best is None or gain > best[0]):
                    best = (gain, key)
            if best is None:
                break
            taken.append(best[1])
            now = sum(1 for u, _ in totals(taken).values() if u >= need)
            out.append((stage, best[1][1], float(best[0]), now))
            if bar is not None and now >= bar:
                return out
    return out


def test_staged_cover_equals_plain_loops(spark):
    counts = [("ab"[h[0] % 2], f"g{h[1] % 9}", f"t{h[2] % 6}", h[3] % 5 + 1) for h in (sha256(str(i).encode()).digest() for i in range(70))]
    merged = Counter()
    for s, g, t, u in counts:
        merged[s, g, t] += u
    rows = [(*k, u) for k, u in merged.items()]
    df = spark.createDataFrame(rows, "stage string, group string, taxon string, units long")
    for protected, bar in (([], None), ([(8, 3)], None), ([(20, 4)], None), ([], 3)):
        assert resolve.staged_cover(df, ["a", "b"], {"a": 4, "b": 3}, 10, protected, bar) == greedy(rows, ["a", "b"], {"a": 4, "b": 3}, 10, protected, bar)


def test_name_column(spark):
    df = spark.createDataFrame([(1, "a.png", "x"), (2, "b.JPG", "y.jpg"), (3, None, "z")], "i int, file string, other string")
    assert frames.name_column(df, ["i", "other", "file"]) == "file" and frames.name_column(df, ["i"]) is None and frames.name_column(df.filter("false"), ["file"]) is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "taxon string, grp string, key string")
    assert evaluation.stepped_draws(none, none, "taxon", "grp", "key", [5], 2, 1).count() == 0
    assert resolve.staged_cover(spark.createDataFrame([], "stage string, group string, taxon string, units long"), ["a"], {"a": 2}, 3, []) == []
