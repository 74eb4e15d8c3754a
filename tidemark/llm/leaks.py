"""Evaluation passages inside training texts.

Method: words are canonicalised to templates (numbers, units and names become
typed placeholders, by counts over all items), windows of seven template words
of items and documents meet in a hash join, and the slots behind the
placeholders are compared: consistent slots mean a repetition, differing ones a
re-parameterised question.  A repetition of 30 words with three edits keeps at
least three unchanged windows, and a window is hashed in every reading that its
words have, so no such passage escapes the join.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import chunks
from tidemark.session import Scratch

WORDS = 30  # consecutive words of the item that must be repeated
EDITS = 3  # of them changed, dropped or added at most
WINDOW = WORDS // (EDITS + 1)  # unchanged run that any such repetition has
MATCHES = WORDS - WINDOW + 1 - EDITS * WINDOW  # unchanged windows that it has at least
LITERAL = 3  # words that a template must state; one with fewer is told by its slots as well
RARE = 0.005  # a word in a smaller share of the items is a name
MOSTLY = 0.5  # share of its uses that makes a word a unit (after a number) or a name (capitalised inside a sentence)
FILTER_WORDS = 1 << 24  # most 64-bit words of a filter (128 MB)
PASS_WINDOWS = 1 << 26  # item windows of one pass over the documents; larger item sets take several
LIST = 64  # items that a document is compared with at once
HELD_WORDS = 200_000  # spellings that a task keeps with their hashes; a shorter memory than a text's words costs nothing but time
# fixed values: letters without a decomposition, and the letters that accents stand on
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
_SIGNS = re.compile("[^0-9a-z]+")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_HYPHEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n\s*(?=\w)")
_GONE = re.compile("[­​-‏⁠﻿]")


def cleaned(text: str) -> str:
    """The text without markup, escapes, hyphenation and invisible characters."""
    t = _TAG.sub(" ", text) if "<" in text else text
    if "&" in t:
        t = html.unescape(t)
    if "\\" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), t)
        t = re.sub(r"\\[nrt]", " ", t)
    if "\n" in t:
        t = _HYPHEN.sub("", t)
    return t if t.isascii() else _GONE.sub("", t)


def readings(low: str) -> tuple[str, str]:
    """(folded, skeleton) of a word in lower case: letters without accents, and only what was ASCII, which a garbled word still has.

    A word of more than four letters of which none is ASCII has its folded form
    for both, since an empty skeleton would equal any other.
    """
    if low.isascii():
        f = low if low.isalnum() else _SIGNS.sub("", low)
        return f, f
    f = "".join(c for c in unicodedata.normalize("NFKD", low.translate(PLAIN)) if c.isalnum())
    s = _SIGNS.sub("", low)
    return f, s or (f if len(low) > 4 else "")


def words_of(text: str) -> tuple[list[str], list[str]]:
    """(folded, skeleton) of each word of a text; a word has a letter or digit."""
    both = [r for r in map(readings, cleaned(text).lower().split()) if r[0]]
    return [f for f, _ in both], [s for _, s in both]


def word_uses(text: str) -> Counter:
    """(word, what) to number, what being in, uses, after (a number), inside (a sentence) and capital, of both readings."""
    out: Counter = Counter()
    start, number = True, False
    for raw in cleaned(text).split():
        both = readings(raw.lower())
        letter = next((c for c in raw if c.isalpha()), "")
        for w in set(both) if both[0] else ():
            out[w, "in"] = 1
            out[w, "uses"] += 1
            out[w, "after"] += number
            out[w, "inside"] += not start
            out[w, "capital"] += not start and letter.isupper() and not raw.isupper()
        number = both[0][:1].isdigit()
        start = raw.rstrip("\"'”»)").endswith((".", "!", "?", ":"))
    return out


def typed_words(items: DataFrame) -> dict[str, str]:
    """Words that templates state, with their kind: literal, or unit (a word that mostly follows a number).

    All others are names: rare ones, and those mostly capitalised inside
    sentences.  The counts are over all items.  As each of the words stands in a
    share RARE of the items, they are at most 1 / RARE times the mean number of
    different words of an item.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total: Counter = Counter()
            for text in frame["item_text"]:
                total.update(word_uses(text))
            yield pd.DataFrame([(w, what, n) for (w, what), n in total.items()], columns=["word", "what", "n"])

    n_items = items.count()
    per = items.select("item_text").mapInPandas(count, "word string, what string, n long").groupBy("word")
    uses = per.agg(*[F.sum(F.when(F.col("what") == x, F.col("n")).otherwise(0)).alias(x) for x in ("in", "uses", "after", "inside", "capital")])
    uses = uses.filter((F.col("in") >= RARE * n_items) & ~F.col("word").rlike("^[0-9]"))
    named = (F.col("capital") > 0) & (F.col("capital") >= MOSTLY * F.col("inside"))
    kind = F.when(F.col("after") >= MOSTLY * F.col("uses"), "unit").when(~named, "literal")
    return {r["word"]: r["kind"] for r in uses.select("word", kind.alias("kind")).filter("kind is not null").collect()}  # bounded as stated


class Vocabulary(dict):
    """Spelling to number; by number: slot and template hash and statedness of both readings, and whether these differ.  -1 is no word."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds
        self.rows: list[tuple] = []

    def reading(self, w: str) -> tuple[int, int, int]:
        own = xxhash.xxh64_intdigest(w, seed=3)
        if w[:1].isdigit():
            return own, 1, 0
        kind = self.kinds.get(w) if w else "literal"
        return own, own if kind == "literal" else 2 if kind == "unit" else 3, int(kind is not None)

    def __missing__(self, low: str) -> int:
        f, s = readings(low)
        if f:
            self.rows.append((*self.reading(f), *self.reading(s), f != s))
        self[low] = at = len(self.rows) - 1 if f else -1
        return at

    def table(self) -> list[np.ndarray]:
        """slot F, template F, stated F, slot S, template S, stated S, differ."""
        if not self.rows:
            return [np.empty(0, np.uint64)] * 7
        kinds = (np.uint64, np.uint64, np.uint64, np.uint64, np.uint64, np.uint64, bool)
        return [np.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)]


STEP = np.array([pow(0x9E3779B97F4A7C15, WINDOW - 1 - k, 1 << 64) for k in range(WINDOW)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, key, slots) of each window of WINDOW words of the texts, in every reading.

    A word whose readings differ is taken either way, each combination of a
    window once.  key is the hash of the template, and of the slots too where
    it states fewer than LITERAL words; slots that of the words themselves.
    """
    if len(vocabulary) > HELD_WORDS:
        vocabulary.clear()
        vocabulary.rows.clear()
    numbers = [np.fromiter(map(vocabulary.__getitem__, cleaned(t).lower().split()), np.int64) for t in texts]
    numbers = [x[x >= 0] for x in numbers]
    sizes = np.array([len(x) for x in numbers])
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(position <= np.repeat(sizes, sizes) - WINDOW)
    slot_f, form_f, stated_f, slot_s, form_s, stated_s, differ = vocabulary.table()

    def total(of: np.ndarray, step: np.ndarray) -> np.ndarray:
        own, out = of[flat] if len(of) else np.empty(0, np.uint64), np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            out += own[at + k] * step[k]
        return out

    one = np.ones(WINDOW, np.uint64)
    slots, form, stated = total(slot_f, STEP), total(form_f, STEP), total(stated_f, one)
    found = [(at, slots, form, stated)]
    if len(flat):
        other = differ[flat]
        some = np.flatnonzero(np.add.reduce([other[at + k] for k in range(WINDOW)]) > 0)
        where = at[some]
        here = np.stack([other[where + k] for k in range(WINDOW)]) if len(where) else np.zeros((WINDOW, 0), bool)
        change = [x[flat] - y[flat] for x, y in ((slot_s, slot_f), (form_s, form_f), (stated_s, stated_f))]
        for choice in range(1, 1 << WINDOW):
            taken = [k for k in range(WINDOW) if choice >> k & 1]
            ok = np.flatnonzero(np.logical_and.reduce(here[taken]))
            if len(ok):
                w, base = where[ok], some[ok]
                sums = [x[base] + sum(c[w + k] * (step[k]) for k in taken) for x, c, step in zip((slots, form, stated), change, (STEP, STEP, one), strict=True)]
                found.append((w, *sums))
    w, slots, form, stated = (np.concatenate(x) for x in zip(*found, strict=True))
    key = np.where(stated >= LITERAL, mixed(form), mixed(slots + np.uint64(1)))
    return text[w], position[w], key.view(np.int64), mixed(slots).view(np.int64)


def filter_places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the filter word, its four bits) of each key; words is a power of two."""
    h = mixed(keys.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    bit = lambda n: np.uint64(1) << ((h >> np.uint64(6 * n)) & np.uint64(63))
    return ((h >> np.uint64(24)) & np.uint64(words - 1)).astype(np.int64), bit(0) | bit(1) | bit(2) | bit(3)


SLICE = 1 << 16  # words of a filter that one row carries


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A blocked Bloom filter of the column key (n rows), 64 bits a key up to FILTER_WORDS words; built in slices by the executors."""
    words = min(FILTER_WORDS, 1 << max(10, (max(n, 1) - 1).bit_length()))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            at, bits = filter_places(frame["key"].to_numpy(np.int64), words)
            for s in np.unique(at // SLICE):
                own = held.setdefault(int(s), np.zeros(min(SLICE, words), np.uint64))
                np.bitwise_or.at(own, at[at // SLICE == s] % SLICE, bits[at // SLICE == s])
        yield pd.DataFrame([(s, x.tobytes()) for s, x in held.items()], columns=["slice", "bits"])

    # the tasks share slices only up to their own number, so that few copies of a slice come to the driver
    tasks = min(8, max(1, words // SLICE))
    out = np.zeros(words, np.uint64)
    for r in keys.select("key").repartition(tasks).mapInPandas(build, "slice int, bits binary").toLocalIterator():
        out[r["slice"] * SLICE : r["slice"] * SLICE + min(SLICE, words)] |= np.frombuffer(r["bits"], np.uint64)
    return out


def anchors(item: tuple[list, list], doc: tuple[list, list]) -> list[tuple[int, int]]:
    """(item position, document position) of the first of each run of WINDOW words that are the same in either reading."""
    n, m = len(item[0]), len(doc[0])
    if n < WINDOW or m < WINDOW:
        return []
    (af, as_), (bf, bs) = (tuple(np.asarray(x) for x in side) for side in (item, doc))
    width, out = max(4 * WINDOW, (1 << 22) // n), []
    for start in range(0, m - WINDOW + 1, width):
        part = slice(start, start + width + WINDOW - 1)
        equal = (af[:, None] == bf[part]) | (as_[:, None] == bs[part])
        run = equal[: n - WINDOW + 1, : equal.shape[1] - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            run &= equal[k : n - WINDOW + 1 + k, k : equal.shape[1] - WINDOW + 1 + k]
        inside = np.zeros_like(run)  # the start of an unchanged run stands for the rest of it
        inside[1:, 1:] = run[:-1, :-1]
        i, j = np.nonzero(run & ~inside)
        out += zip(i.tolist(), (j + start).tolist(), strict=True)
    return out


def coverage(item: tuple[list, list], doc: tuple[list, list]) -> tuple[int, int]:
    """(most consecutive item words repeated with at most EDITS edits, edits of that stretch).

    From every unchanged run of WINDOW words the match is extended both ways
    along the furthest diagonals, sharing EDITS between the two sides.
    """
    a, b = item, doc
    n, m = len(a[0]), len(b[0])

    def same(i: int, j: int) -> bool:
        return a[0][i] == b[0][j] or (a[1][i] == b[1][j])

    def reach(i: int, j: int, step: int) -> list[int]:
        """Item words passed beyond (i, j) in a direction, for 0 to EDITS edits."""
        room = n - i if step > 0 else i + 1
        width = m - j if step > 0 else j + 1

        def slide(x: int, y: int) -> int:
            while x < room and y < width and same(i + step * x, j + step * y):
                x, y = x + 1, y + 1
            return x

        far = {0: slide(0, 0)}  # diagonal (item minus document) to item words passed
        best = [far[0]]
        for _ in range(EDITS):
            nxt: dict[int, int] = {}
            for d, x in far.items():
                y = x - d
                for dd, xx, yy in ((d, x + 1, y + 1), (d + 1, x + 1, y), (d - 1, x, y + 1)):
                    if xx <= room and yy <= width or (xx <= room and dd == d and yy == width + 1):
                        got = slide(xx, min(yy, width)) if yy <= width else xx
                        if got > nxt.get(dd, -1):
                            nxt[dd] = got
            far = nxt or far
            best.append(max(best[-1], max(far.values(), default=0)))
        return best

    best, best_edits = 0, 0
    for i, j in anchors(a, b):
        fore, back = reach(i, j, 1), reach(i - 1, j - 1, -1)
        for e in range(EDITS + 1):
            got = max(fore[e - left] + back[left] for left in range(e + 1))
            if got > best:
                best, best_edits = got, e
    return best, best_edits


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, words, edits, kind) for documents that contain passages of items.

    kind is ``repeated`` where at least WORDS consecutive item words stand in
    the document with at most EDITS changed, dropped or added; ``reparameterised``
    where the template windows cover half of the item but the slots differ.
    shared is the number of the item's windows whose template the document has.
    Items under WORDS words, null and empty texts never count; an item or
    document id that is null is left out; repeats of a document or item id are
    read together; empty tables give no row.
    """
    scratch = Scratch(spark, "leaks")
    kept_items = scratch.save(items.filter("item_id is not null and length(text) > 0").select("item_id", F.col("text").alias("item_text")), "items")
    kinds = typed_words(kept_items)

    def hash_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(kinds)
        for frame in frames:
            text, position, key, slots = windows(frame["item_text"].tolist(), vocabulary)
            yield pd.DataFrame({"item_id": frame["item_id"].to_numpy()[text], "pos": position, "key": key, "item_s": slots})

    own = scratch.save(kept_items.mapInPandas(hash_items, "item_id long, pos int, key long, item_s long").distinct(), "item-windows")
    passes = max(1, -(-own.count() // PASS_WINDOWS))
    found = None
    for part in range(passes):
        of = own if passes == 1 else own.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part)
        pairs = _pairs(spark, scratch, documents, kept_items, of, kinds, str(part))
        found = pairs if found is None else found.unionByName(pairs)
    best = F.max(F.struct("words", (-F.col("edits")).alias("e"), "shared", "kind")).alias("b")
    out = found.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "b.shared", "b.words", (-F.col("b.e")).alias("edits"), "b.kind")


def meeting(texts: list[str], ids: list[int], known: np.ndarray, vocabulary: Vocabulary) -> list[tuple]:
    """(id, text, keys, slots) of the texts with windows at MATCHES places or more that the filter knows."""
    text, position, key, slots = windows(texts, vocabulary)
    at, bits = filter_places(key, len(known))
    hit = (known[at] & bits) == bits
    text, position, key, slots = (x[hit] for x in (text, position, key, slots))
    # windows at fewer than MATCHES places are no case
    places = np.bincount(np.unique(np.stack([text, position]), axis=1)[0], minlength=len(texts)) if len(text) else np.zeros(len(texts), int)
    order = np.argsort(text, kind="stable")
    cut = np.searchsorted(text[order], np.arange(len(texts) + 1))
    rows = []
    for i in np.flatnonzero(places >= MATCHES):
        mine = order[cut[i] : cut[i + 1]]
        both = np.unique(np.stack([key[mine], slots[mine]]), axis=1)
        rows.append((ids[i], texts[i], both[0].tolist(), both[1].tolist()))
    return rows


def _pairs(spark: SparkSession, scratch: Scratch, documents: DataFrame, items: DataFrame, own: DataFrame, kinds: dict[str, str], tag: str) -> DataFrame:
    keys = own.select("key").distinct()
    shared_filter = spark.sparkContext.broadcast(key_filter(keys, keys.count()))  # at most FILTER_WORDS

    def hash_documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, vocabulary = shared_filter.value, Vocabulary(kinds)
        for frame in frames:
            every, ids = frame["text"].tolist(), frame["doc_id"].tolist()
            for part in chunks(every):
                yield pd.DataFrame(meeting(every[part], ids[part], known, vocabulary), columns=["doc_id", "doc_text", "k", "s"])

    texts = documents.filter("doc_id is not null and length(text) > 0").select("doc_id", "text")
    candidates = scratch.save(texts.mapInPandas(hash_documents, "doc_id long, doc_text string, k array<long>, s array<long>"), f"candidates-{tag}")
    hits = candidates.select("doc_id", F.inline(F.arrays_zip("k", "s"))).distinct()
    met = hits.join(own, hits["k"] == own["key"]).groupBy("doc_id", "item_id", "pos").agg(F.max(F.col("s") == F.col("item_s")).alias("same"))
    pairs = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.count_if("same").alias("consistent"))
    sizes = own.groupBy("item_id").agg((F.max("pos") + 1).alias("windows"))
    # consistent slots may make a repetition; half of an item's templates, whatever their slots, a re-parameterised one
    likely = (F.col("windows") > WORDS - WINDOW) & ((F.col("consistent") >= MATCHES) | (F.col("shared") >= F.greatest(F.lit(MATCHES), F.col("windows") / 2)))
    pairs = pairs.join(sizes, "item_id").filter(likely).join(items, "item_id")
    lists = pairs.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(1 << 20))).withColumn("part", F.floor(F.col("part") * F.ceil(F.count("*").over(Window.partitionBy("doc_id")) / LIST) / (1 << 20)))
    lists = lists.groupBy("doc_id", "part").agg(F.collect_list(F.struct("item_id", "shared", "windows", "item_text")).alias("found"))  # about LIST items
    with_text = lists.join(candidates.select("doc_id", "doc_text"), "doc_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary({})

        def hashed(text: str) -> tuple[list, list]:
            if len(vocabulary) > HELD_WORDS:
                vocabulary.clear()
                vocabulary.rows.clear()
            numbers = [x for x in map(vocabulary.__getitem__, cleaned(text).lower().split()) if x >= 0]
            return [vocabulary.rows[x][0] for x in numbers], [vocabulary.rows[x][3] for x in numbers]

        known: dict[str, tuple[list, list]] = {}
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc = hashed(text)
                for f in found:
                    if len(known) > 5000:
                        known.clear()
                    item = known.get(f["item_text"])
                    if item is None:
                        item = known[f["item_text"]] = hashed(f["item_text"])
                    words, edits = coverage(item, doc)
                    kind = "repeated" if words >= WORDS else "reparameterised" if f["shared"] >= f["windows"] / 2 else ""
                    if kind and len(item[0]) >= WORDS:
                        rows.append((doc_id, f["item_id"], f["shared"], words, edits, kind))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()], strict=True)], names=["doc_id", "item_id", "shared", "words", "edits", "kind"])

    # Python work per row far exceeds its bytes, so the number of tasks follows the cores, not the size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ready = with_text.select("doc_id", "doc_text", "found").repartition(tasks)
    return scratch.save(ready.mapInArrow(verify, "doc_id long, item_id long, shared long, words long, edits long, kind string"), f"verified-{tag}")
