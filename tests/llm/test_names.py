import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import names as N

REFERENCE = [
    (1, "Gadus morhua", "Species", "Gadidae", "Gadus", "barred murl"),
    (2, "Gadus chalcogrammus", "Species", "Gadidae", "Gadus", None),
    (3, "Gadus", "Genus", "Gadidae", "Gadus", None),
    (4, "Gadidae", "Family", "Gadidae", None, None),
    (5, "Sebastes norvegicus", "Species", "Sebastidae", "Sebastes", None),
    (6, "Sebastes", "Genus", "Sebastidae", "Sebastes", None),
    (7, "Scomber morhuana", "Species", "Scombridae", "Scomber", None),
]
TYPED = [
    ("Gadus morhua", 1), ("GADUS MORHUA", 1), ("gadus MORHUA juv", 1), ("Gadus cf. morhua", 1), ("?Gadus morhua", 1), ("Gadus_morhua", 1), ("GadusMorhua", 1), ("morhua, Gadus", 1), ("Gadus morhua (Linnaeus, 1758)", 1), ("Gadus morhua Linnaeus 1758", 1),
    ("Gadvs morhua", 1), ("Gаdus mоrhua", 1), ("Gádus morhúa", 1), ("G. chalcogrammus", 2), ("Gad. chalcogramus", 2), ("Gadus chalco", 2), ("Gadus sp.", 3), ("unid. Gadus", 3), ("GADUS", 3), ("gadidae", 4), ("fam. Gadidae", 4), ("Barred Murl", 1), ("bared murl", 1), ("Sebastes norvegicus - distant", 5), ("Sebastse norvegicuss", 5),
    ("Gadus inventus", 0), ("Gadus norvegicus", 0), ("Xenus morhua", 0), ("plastic bag", 0), ("???", 0), ("n/a", 0), ("", 0), ("x" * 50_000, 0), ("fish", 0), ("S. chalcogrammus", 0),
]
SCHEMA = "map_id long, family string, genus string, species string, proposed_name string, aphia_id long, found string, score double"


def reference(spark):
    return spark.createDataFrame(REFERENCE, "aphia_id long, valid_name string, taxon_rank string, family string, genus string, vernacular string")


def test_typed_names(spark):
    rows = [(i, None, None, None, t, None, "clash", 1.0) for i, (t, _) in enumerate(TYPED)]
    rows += [(900, None, "Gadus", "morhua", None, None, None, None), (901, "Gadidae", None, None, None, None, None, None), (902, None, "Sebastes", "Sebastes norvegicus", None, None, None, None), (903, None, "Sebastes", None, " ", None, None, None), (904, None, None, None, "Gadus morhua", 1, None, None), (None, None, None, None, "Gadus", None, None, None)]
    rows += [rows[0], rows[3]]
    got = {r["map_id"]: r["aphia_id"] for r in N.map_names(spark, spark.createDataFrame(rows, SCHEMA), reference(spark)).collect()}
    want = {i: a for i, (_, a) in enumerate(TYPED)} | {900: 1, 901: 0, 902: 5, 903: 6}
    assert {i: (TYPED[i][0][:40] if i < 900 else i, got[i]) for i in want if got[i] != want[i]} == {} and set(got) == set(want)


def test_status_and_report(spark):
    rows = [(1, None, None, None, "Gadus morhua", None, None, None), (2, None, None, None, "Gadus morhva", None, None, None), (3, None, None, None, "rope", None, None, None)]
    got = {r["map_id"]: (r["valid_name"], r["status"]) for r in N.map_names(spark, spark.createDataFrame(rows, SCHEMA), reference(spark)).collect()}
    assert got == {1: ("Gadus morhua", "exact"), 2: ("Gadus morhua", "repaired"), 3: (None, "unmatched")}


def test_repair_loses_no_pair(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    vocabulary = sorted({word(rng.randint(3, 9)) for _ in range(60)})
    tokens = sorted({word(rng.randint(3, 9)) for _ in range(120)} | set(vocabulary[:10]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    # both sides drop as many letters as their own length allows, so the pair's allowance is that of the shorter
    want = {(t, w) for t in tokens for w in vocabulary if distance(t, w) <= min(N.edits(len(t)), N.edits(len(w)))}
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = {(r["token"], r["word"]) for r in N.repair(df(tokens, "token"), df(vocabulary, "word")).collect()}
    assert want <= got


@pytest.mark.parametrize("side", ["typed", "reference", "both"])
def test_empty_tables(spark, side):
    typed = spark.createDataFrame([(1, None, None, None, "Gadus", None, None, None)] if side == "reference" else [], SCHEMA)
    ref = reference(spark) if side == "typed" else reference(spark).filter(F.lit(False))
    got = N.map_names(spark, typed, ref).collect()
    assert [r["aphia_id"] for r in got] == ([0] if side == "reference" else [])
