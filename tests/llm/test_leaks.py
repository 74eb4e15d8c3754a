import random

from tidemark.llm import leaks as L

WORDS = "amber anchor basket beacon bottom bucket cable camera canal coral current depth diver drift edge field float frame gravel harbour hatch kelp ladder lantern ledge mast net ochre paddle pallet reef rope rudder sand shackle shell sieve slope spool tide tripod valve wedge wheel winch".split()
DOCS = "doc_id long, text string, item_id long, kind string"
ITEMS = "item_id long, text string, answer string"


def passage(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + (str(rng.randint(1, 99)) if rng.random() < 0.05 else "") for _ in range(n)]


def best(item, doc):
    """Most consecutive item words within 3 edits of a stretch of the document (all windows, full table)."""
    n, m, top = len(item), len(doc), 0
    for i in range(n):
        row = [0] * (m + 1)
        for length in range(1, n - i + 1):
            nxt = [length]
            for j in range(1, m + 1):
                nxt.append(min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (item[i + length - 1] != doc[j - 1])))
            row = nxt
            if min(row) <= 3:
                top = max(top, length)
    return top


def test_coverage_equals_full_alignment():
    rng = random.Random(9)
    for seed in range(12):
        item = passage(seed, 45)
        start, length = rng.randint(0, 10), rng.randint(25, 35)
        part = item[start : start + length]
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["odd"], ["odd", part[k]]])
        doc = passage(100 + seed, 15) + part + passage(200 + seed, 15)
        got, edits = L.coverage((item, item), (doc, doc))
        want = best(item, doc)
        # short repetitions need no unchanged run of seven words
        assert (got >= L.WORDS) == (want >= L.WORDS) and edits <= L.EDITS and (got == want or want < L.WORDS)


def disguised(words):
    text = " ".join(words)
    half = len(words) // 2
    return {
        "plain": text,
        "capitals": text.upper(),
        "markup": "<p>" + "</p>\n<p>".join([" ".join(words[:half]), " ".join(words[half:])]) + "</p>",
        "punctuated": ", ".join(words) + ".",
        "spaces": " ".join(words),
        "zero width": text.replace("e", "e​"),
        "hyphens": text.replace("current", "cur-\nrent"),
        "accents": text.replace("a", "á"),
        "json": '{"q": "' + text.replace("e", "\\u00e9") + '"}',
        "long": "filler " * 30_000 + text + " filler" * 30_000,
    }


def test_disguises_and_limits(spark, rows):
    item = passage(1)
    accented = "Le sabot près du coffre où l’élève a noté dérivé et détaché de la caméra cachée derrière le rocher élevé sous une lumière très pâle au fond de la baie où la marée a monté".split()
    docs, want = [], set()
    for i, text in enumerate(disguised(item).values()):
        docs.append((i, text))
        want.add((i, 10))
    garbled = " ".join(accented).encode().decode("cp1252", "ignore")
    docs += [(50, "x " + garbled), (51, " ".join(item[:29])), (52, " ".join(item[:30])), (53, " ".join(item[:13] + ["odd"] + item[14:20] + item[21:31])), (54, " ".join(w if i % 6 else "odd" for i, w in enumerate(item))), (55, None), (56, ""), (None, " ".join(item)), (52, " ".join(item[:30]))]
    want |= {(50, 20), (52, 10), (53, 10)}
    items = [(10, " ".join(item), "A"), (20, " ".join(accented), None), (30, " ".join(item[:25]), None), (40, None, None), (41, "", None), (None, " ".join(item), None)]
    # 29 words repeated and one changed at their end are 30 words with one change
    want.add((51, 10))
    got = L.leaks(spark, spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS)).filter("kind = 'repeated'")
    assert set(rows(got, "doc_id", "item_id")) == want and got.count() == len(want)


def test_reparameterised(spark):
    words = [f"{i}" if i % 3 == 0 else w for i, w in enumerate(passage(4))]
    other = [f"{i + 500}" if i % 3 == 0 else w for i, w in enumerate(passage(4))]
    got = L.leaks(spark, spark.createDataFrame([(1, " ".join(other), 0, "")], DOCS), spark.createDataFrame([(7, " ".join(words), "")], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in got] == [(1, 7, "reparameterised")]


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(7, " ".join(passage(1)), "")], ITEMS)
    assert L.leaks(spark, docs, items).count() == L.leaks(spark, docs, one).count() == 0
    assert L.leaks(spark, spark.createDataFrame([(1, "a b", 0, "")], DOCS), items).count() == 0


def test_numbers_alone_are_found(spark, rows):
    """All windows of a table of numbers have one template; their slots tell them apart."""
    rng = random.Random(3)
    numbers = [str(rng.randint(100, 999)) for _ in range(40)]
    docs = [(1, "see " + " ".join(numbers) + " end", 0, ""), (2, " ".join(reversed(numbers)), 0, ""), (3, " ".join(["7"] * 60), 0, "")]
    items = [(5, " ".join(numbers), ""), (6, " ".join(["7"] * 40), "")]
    got = L.leaks(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).filter("kind = 'repeated'")
    assert rows(got, "doc_id", "item_id") == [(1, 5), (3, 6)]


def mixed_spelling(words, rng):
    """Each word as it is, without accents, or garbled."""
    import unicodedata

    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return [rng.choice([w, plain(w), w.encode().decode("cp1252", "ignore").replace("\xa0", "")]) for w in words]


def test_mixed_readings_and_edits_are_found(spark, rows):
    """30 words, each spelled in one of three ways, with three of them changed, dropped or added."""
    vocabulary = [w.translate(str.maketrans({"a": "á", "o": "ô"})) if i % 2 else w for i, w in enumerate(WORDS)]
    docs, want = [], set()
    items = []
    for seed in range(40):
        rng = random.Random(seed)
        item = [rng.choice(vocabulary) for _ in range(50)]
        items.append((seed, " ".join(item), ""))
        start = rng.randint(0, 20)
        part = mixed_spelling(item[start : start + 30], rng)
        for k in sorted(rng.sample(range(2, 28), 3), reverse=True):
            part[k : k + 1] = rng.choice([["odd"], [part[k], "odd"], ["odd"]])
        docs.append((seed, "x y z " + " ".join(part) + " z y x", 0, ""))
        want.add((seed, seed))
    got = set(rows(L.leaks(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).filter("kind = 'repeated'"), "doc_id", "item_id"))
    assert want <= got


def test_slots_are_told_by_counts_not_by_length(spark, rows):
    """A short name in another's place is a slot, a long common word is none."""
    frames = "{2} measured the temperature of the water near the station while {0} and the information about {1} under the harbour wall of {2} was taken from {1} over the long temperature chart of the old station near {0} and the {2} of the fleet".split()
    def made(names):
        return " ".join(frames).format(*names)
    items = [(i, made([f"fish{chr(97 + i)}", f"{10 + i}", f"ship{chr(97 + i)}"]), "") for i in range(12)] + [(100 + i, " ".join(passage(i)), "") for i in range(1900)]
    got = L.leaks(spark, spark.createDataFrame([(1, made(["eel", "77", "tug"]), 0, "")], DOCS), spark.createDataFrame(items, ITEMS))
    assert rows(got, "doc_id", "item_id", "kind") == [(1, i, "reparameterised") for i in range(12)]


def test_item_sets_beyond_one_pass(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "PASS_WINDOWS", 60)
    items = [(i, " ".join(passage(i)), "") for i in range(6)]
    got = L.leaks(spark, spark.createDataFrame([(i, "so " + " ".join(passage(i)), 0, "") for i in range(6)], DOCS), spark.createDataFrame(items, ITEMS)).filter("kind = 'repeated'")
    assert rows(got, "doc_id", "item_id") == [(i, i) for i in range(6)]


def test_filter_keeps_every_key():
    import numpy as np

    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    bits = np.zeros(1024, np.uint64)
    at, own = L.filter_places(keys, 1024)
    np.bitwise_or.at(bits, at, own)
    assert ((bits[at] & own) == own).all()
