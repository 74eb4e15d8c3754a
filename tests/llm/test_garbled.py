import random

import pytest

from tidemark.llm import garbled as G

NAMES = "Míra Gråsund Østvik Żabi Ñuñe Élier Baie Corrin Kestrel Tolmen".split()
TEMPLATES = {
    "en": ["The crew – {} people – took turns at the winch until noon.", "It’s not clear whether the {} seen near {} are the same animal.", "The water was {} °C at the bottom; “nothing to annotate” was entered near {}."],
    "fr": ["La caméra a touché le fond à {} m, près de {}.", "Où sont passées les données répétées de {} ?", "L’espèce n’a pas été revue après la marée de l’été à {}."],
    "de": ["Außerdem müssen die Größen von {} überprüft und die Lücken geschlossen werden.", "Der Köder war nach {} Minuten völlig aufgelöst, früher als üblich."],
    "pl": ["Przynęta zniknęła po {} minutach, a prąd się wzmógł.", "Zdjęcia z wyprawy {} są nieostre i wymagają powtórzenia.", "Światło było zbyt słabe, więc ujęcie {} skrócono."],
    "ru": ["Приманка исчезла через {} минут, течение усилилось.", "Снимки станции {} получились мутными, их нужно переснять.", "Света не хватало, поэтому запись {} пришлось сократить."],
    "pt": ["NÃO FORAM FEITAS CORREÇÕES na estação {} até à data.", "A iluminação era fraca e a anotação {} ficou por confirmar."],
}
SYMBOLS = "├── raw\n│   ├── left\n└── done\nΔt = {} ms, Σ boxes = 3, √n ≈ 9"
DOCS = "doc_id long, text string, lang string, restored string"


def correct(seed):
    rng = random.Random(seed)
    lang = rng.choice(sorted(TEMPLATES))
    text = " ".join(rng.choice(TEMPLATES[lang]).format(rng.choice(NAMES + [str(rng.randint(1, 400))]), rng.choice(NAMES)) for _ in range(5))
    return (text + "\n" + SYMBOLS.format(rng.randint(1, 99)) if seed % 20 == 0 else text), lang


@pytest.fixture(scope="module")
def model():
    texts = [correct(i) for i in range(700)]
    # some of what it learns from is garbled already, as in real data
    return G.train([t.encode().decode("cp1252", "ignore") if i % 40 == 3 else t for i, (t, _) in enumerate(texts)], [lang for _, lang in texts])


def test_held_out_correct_texts_are_no_cases(model):
    texts = [correct(i)[0] for i in range(5000, 5600)]
    assert sum(G.restore_text(model, t)[2] for t in texts) <= 3
    for t in ("", "plain ascii", SYMBOLS.format(4), correct(5001)[0].upper(), correct(5002)[0].replace(" ", " ")):
        assert not G.restore_text(model, t)[2]


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "mac_roman"),), (("utf-8", "cp437"),), (("utf-8", "latin-1"),) * 2], ids=str)
def test_round_trip_of_multibyte_chains(model, chain):
    done = found = same = 0
    for i in range(6000, 6200):
        text = correct(i)[0]
        bad = text
        try:
            for w, r in chain:
                bad = bad.encode(w).decode(r)
        except UnicodeError:
            continue
        if bad == text:
            continue
        restored, used, garbled = G.restore_text(model, bad)
        done, found, same = done + 1, found + garbled, same + (restored == text)
    assert done > 30 and found >= 0.98 * done and same >= 0.85 * done


@pytest.mark.parametrize("written, read, lang", [("cp1251", "cp1252", "ru"), ("cp1251", "koi8-r", "ru"), ("koi8-r", "cp1251", "ru"), ("cp1250", "cp1252", "pl"), ("cp1252", "cp437", "fr"), ("cp1252", "mac_roman", "de")])
def test_round_trip_of_single_byte_chains(model, written, read, lang):
    done = found = same = 0
    for i in range(7000, 7600):
        text, own = correct(i)
        text = text.encode(written, "replace").decode(written)  # what the encoding cannot write was lost before
        bad = G.garble(text, ((written, read),)) if own == lang else None
        if bad is None:
            continue
        restored, _, garbled = G.restore_text(model, bad)
        done, found, same = done + 1, found + garbled, same + (restored == text)
    assert done > 5 and found >= 0.95 * done and same >= 0.6 * done


def test_parts_and_losses(model):
    good, bad = "Où sont passées les données répétées de Corrin ?", "La caméra a touché le fond à 8 m, près de Míra.".encode().decode("cp1252", "ignore")
    restored, used, garbled = G.restore_text(model, f"{good} {bad}")
    assert garbled and restored.startswith(good) and used
    assert G.restore_text(model, "ship���s time")[2]


def test_restore_table(spark):
    rows = [(i, *correct(i), "clash") for i in range(400)]
    rows += [(1000, "La caméra a touché le fond à 8 m, près de Míra.".encode().decode("cp1252", "ignore"), "fr", None), (1001, None, None, None), (1002, "", "en", None), (1003, "x " * 200_000 + "ItÃ©", None, None), (1000, "La caméra a touché le fond à 8 m, près de Míra.".encode().decode("cp1252", "ignore"), "fr", None)]
    got = G.restore(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in got} >= {1000} and {r["doc_id"] for r in got} <= {1000, 1003}
    assert next(r for r in got if r["doc_id"] == 1000)["restored"].startswith("La caméra a touché")
    assert G.restore(spark, spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("part", [False, True], ids=["whole", "word by word"])
def test_every_chain_above_the_prior_is_inverted(model, part):
    import numpy as np

    chain = (("cp1251", "cp1252"),)
    right = TEMPLATES["ru"][0].format(12)
    bad = right.encode("cp1251").decode("cp1252")
    if part:  # a lost character: the sentence as a whole can't be inverted
        bad, right = bad + " " + G.LOST, right + " " + G.LOST
    odds = np.full(len(model.chains), G.PRIOR - 1, np.float32)
    c = model.chains.index(chain)
    wrong = [i for i in range(len(odds)) if i != c and not any(w == "utf-8" for w, _ in model.chains[i]) and model.chains[i][0][0] not in ("cp1251",)][:12]
    odds[wrong], odds[c] = G.PRIOR + 9, G.PRIOR + 1
    text, used, garbled = G.restore_segment(model, bad, odds)
    assert garbled and text == right and used == "cp1251>cp1252" + " in part" * part


def test_counts_are_those_of_all_documents(spark):
    """A letter that only part of the documents has, none of them in the sample, is known; a garbled text that is copied a thousand times is not."""
    import numpy as np

    bad = "La caméra a touché le fond près de Míra.".encode().decode("cp1252", "ignore")
    rows = [(i, correct(i)[0], "en", "") for i in range(600)] + [(5000 + i, bad, "fr", "") for i in range(1000)] + [(9000, None, None, None), (9001, "", None, None)]
    documents = spark.createDataFrame(rows, DOCS).repartition(5)
    counts = G.count_corpus(documents)
    local = G.count_texts([t for _, t, _, _ in rows if t])
    assert counts.common == local.common and counts.lines == local.lines and (counts.known == local.known).all() and np.allclose(counts.rate, local.rate, atol=1e-3)
    found = {r["doc_id"] for r in G.restore(spark, documents, G.train([t for _, t, _, _ in rows[:300]], None, counts)).collect()}
    assert {5000 + i for i in range(1000)} <= found and len(found) <= 1006


def test_one_garbled_word_in_a_sentence_is_found(model):
    """Few characters tell little to the classifier; that they pair as in no correct text does."""
    done = found = 0
    for i in range(8000, 8300):
        text = correct(i)[0]
        words = text.split(" ")
        odd = [k for k, w in enumerate(words) if sum(not c.isascii() for c in w) > 1]
        if odd:
            rng = random.Random(i)
            k, read = rng.choice(odd), rng.choice(["cp1252", "mac_roman", "cp437"])
            words[k] = words[k].encode().decode(read, "ignore")
            done, found = done + 1, found + G.restore_text(model, " ".join(words))[2]
    assert done > 100 and found >= 0.97 * done
