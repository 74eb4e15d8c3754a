"""Finding and undoing wrong character encodings.

A multinomial classifier over hashed byte bigrams, trained on synthetically
garbled records, predicts for each sentence the chain of encodings (written as,
read as) that garbled it, or none.  The chain is inverted; the result counts if
it decodes strictly and consists of character pairs that correct text has.  What
correct text has is counted over all documents; the classifier is fitted on a
bounded sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import chunks

# fixed values: encodings that texts were written in, and that they were read as
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "mac_roman", "cp850", "cp437")
READ = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "mac_roman", "cp437", "cp850", "cp852")
TWICE = (("utf-8", "latin-1"), ("utf-8", "cp1252"))  # chains that are also applied two times over
BUCKETS = 1 << 15
PAIRS = 1 << 20  # hashed pairs of characters
HELD_WORDS = 50_000  # words whose inversions a task keeps
SAMPLE_DOCS = 6000  # bound of the labelled sample
SAMPLE_CHARS = 20_000  # longer texts are not sampled, so the sample stays under 120 MB (they are repaired like all others)
SAMPLE_SEGMENTS = 2500  # correct sentences that are garbled for training
COMMON = 0.02  # a character in this share of the documents is taken as correct
OFTEN = 0.0005  # a pair of characters in sentences of this share of the documents is known
RAREST = OFTEN / 20  # share that a pair counts with which is not known
SHARED = 0.002  # a line of symbols in this share of the documents is meant as such
HOT = 20_000  # a text counts as one however often it is repeated, where it makes up more than the HOT-th part of the rows
SMOOTH = 0.02
PRIOR = 1.0  # log odds against garbling
SURE = 14.0  # log odds that suffice where characters were lost and nothing can be inverted
BETTER = 0.1  # by so much the restored byte pairs must be known better
GAIN = 3.0  # log likelihood as correct text that restoring must add
UNLIKELY = 8.0  # the same for a chain whose odds are below the prior
KNOWN = 0.75  # share of the restored byte pairs that correct text must have
LOST = "�"
# fixed values: punctuation and signs that correct text of any language may have
TYPOGRAPHIC = frozenset("‘’“”„«»–—…°±²³×§")
_BREAK = re.compile(r"((?<=[.!?])[ \t]+|\n+)")
_DRAWN = re.compile(r"^[\s←-⇿∀-⋿⌀-⏿─-◿]*$")


def bigrams(text: str) -> np.ndarray:
    """Hashed byte pairs of the UTF-8 form with at least one byte outside ASCII."""
    b = np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8).astype(np.int64)
    pair = (b[:-1] << 8) | b[1:]
    pair = pair[(b[:-1] | b[1:]) >= 0x80]
    return (pair * 40503 + (pair >> 5)) % BUCKETS


def char_pairs(text: str) -> np.ndarray:
    """Hashed pairs of characters with at least one outside ASCII; all digits are alike, an outer space on either side."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return _hash_pairs(c)[(c[:-1] | c[1:]) > 126]


def _hash_pairs(c: np.ndarray) -> np.ndarray:
    c = np.where((c >= 48) & (c < 58), 48, c)
    h = c[:-1] * 0x9E3779B1 + c[1:] * 0x85EBCA77
    return (h ^ (h >> 21)) & (PAIRS - 1)


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain, or None where it can't be written or nothing changes."""
    out = text
    try:
        for written, read in chain:
            out = out.encode(written).decode(read, "ignore")
    except UnicodeError:
        return None
    return out if out != text else None


def _bytes(text: str, read: str) -> bytes:
    """Bytes that were read as this text; for cp1252 also the five that stand for themselves."""
    if read == "cp1252" and any("\x80" <= c <= "\x9f" for c in text):
        return b"".join(c.encode("latin-1") if c in "\x81\x8d\x8f\x90\x9d" else c.encode("cp1252") for c in text)
    return text.encode(read)


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain if that decodes strictly."""
    try:
        for written, read in reversed(chain):
            text = _bytes(text, read).decode(written)
    except UnicodeError:
        return None
    return text


def invert_all(text: str, of: list[tuple[tuple[str, str], ...]]) -> Iterator[tuple[int, str]]:
    """(number of the chain, text before it) of the chains that invert strictly to another text; each reading is undone once."""
    raw: dict[str, bytes | None] = {}
    for c, chain in enumerate(of):
        written, read = chain[-1]
        if read not in raw:
            try:
                raw[read] = _bytes(text, read)
            except UnicodeError:
                raw[read] = None
        if (b := raw[read]) is not None:
            try:
                back = b.decode(written)
            except UnicodeError:
                continue
            if len(chain) > 1:
                back = invert(back, chain[:-1])
            if back is not None and back != text:
                yield c, back


def chains() -> list[tuple[tuple[str, str], ...]]:
    single = [((w, r),) for w in WRITTEN for r in READ if w != r]
    return single + [(c, c) for c in TWICE]


@dataclass
class Counts:
    """What correct text has, over all documents: characters, pairs of them, lines of symbols."""

    common: frozenset[str]
    known: np.ndarray
    rate: np.ndarray  # log share of the texts that have the pair
    lines: frozenset[str]


@dataclass
class Model:
    """log_p[class, bucket]: first the chains, then correct text by language; known are the character pairs that correct text has."""

    chains: list[tuple[tuple[str, str], ...]]
    log_p: np.ndarray
    known: np.ndarray
    rate: np.ndarray
    seen: np.ndarray
    letters: frozenset[str]
    words: dict = field(default_factory=dict)  # what a task has found for words


@lru_cache(maxsize=1 << 16)
def _utf8_run(run: str) -> frozenset[str]:
    """What the run may have been if it is UTF-8 read one byte at a time."""
    backs = (invert(run, (("utf-8", read),)) for read in ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "cp1250", "iso8859-2"))
    return frozenset(b for b in backs if b is not None and len(b) < len(run))


def looks_utf8(text: str, common: frozenset[str]) -> bool:
    """True if a run of characters is UTF-8, of common characters, read one byte at a time."""
    return any(common.issuperset(b) for run in re.findall(r"[^\x00-\x7f]{2,}", text) for b in _utf8_run(run))


def sentences(text: str) -> set[str]:
    """The distinct sentences of a text that are not ASCII, digits masked."""
    return {re.sub(r"\d+", "0", s) for s in _BREAK.split(text)[::2] if not s.isascii()}


def chars_of(rows: Iterable[tuple[str, float]]) -> Counter:
    """Weighted number of texts of each character outside ASCII."""
    out: Counter = Counter()
    for text, weight in rows:
        for c in set(text):
            if ord(c) > 126:
                out[c] += weight
    return out


def pairs_of(rows: Iterable[tuple[str, float]], common: frozenset[str]) -> tuple[np.ndarray, Counter]:
    """Weighted number of texts of each character pair in sentences of common characters, and of each line of symbols."""
    pairs, lines = np.zeros(PAIRS), Counter()
    for text, weight in rows:
        own = []
        for s in sentences(text):
            odd = {c for c in s if ord(c) > 126}
            if odd <= common:
                if not looks_utf8(s, common):
                    own.append(s)
            elif LOST not in s and all(c in common or not c.isalpha() or "\u0370" <= c <= "\u03ff" or c == "µ" for c in odd):
                lines[s] += weight
        if own:
            pairs[np.unique(char_pairs("  ".join(own)))] += weight
    return pairs, lines


def common_of(chars: dict[str, float], n: float) -> frozenset[str]:
    return frozenset({c for c, x in chars.items() if x >= max(2, COMMON * n)} | TYPOGRAPHIC) - {LOST}


def counts_of(pairs: np.ndarray, lines: dict[str, float], common: frozenset[str], n: float) -> Counts:
    shared = frozenset(s for s, x in lines.items() if x >= max(3, SHARED * n) and not looks_utf8(s, common))
    known = pairs >= max(2, OFTEN * n)
    for s in shared:
        known[char_pairs(s)] = True
        pairs[char_pairs(s)] = np.maximum(pairs[char_pairs(s)], OFTEN * n)
    rate = np.log(np.maximum(np.where(known, pairs / max(n, 1), 0), RAREST)).astype(np.float32)
    return Counts(common, known, rate, shared)


def count_texts(texts: list[str]) -> Counts:
    """The counts over a list of texts, each once."""
    rows = [(t, 1.0) for t in dict.fromkeys(texts)]
    common = common_of(chars_of(rows), len(rows))
    return counts_of(*pairs_of(rows, common), common, len(rows))


def count_corpus(documents: DataFrame) -> Counts:
    """The counts over all documents.

    What comes to the driver is bounded by the shares asked for: at most
    1 / COMMON times the mean number of different characters of a text, 1 / OFTEN
    times its pairs, 1 / SHARED times its lines, and HOT hashes of texts that
    are repeated so often that they would sway a share.
    """
    spark = documents.sparkSession
    texts = documents.filter(F.length("text") > 0).select("text", F.xxhash64("text").alias("h"))
    n = texts.count()
    hot = texts.groupBy("h").agg(F.count("*").cast("double").alias("copies")).filter(F.col("copies") >= max(2, n / HOT))
    spread = hot.agg(F.sum("copies").alias("rows"), F.count("*").alias("texts")).head()
    n = n - (spread["rows"] or 0) + spread["texts"]
    odd = texts.filter(F.col("text").rlike("[^\\x00-\\x7e]"))
    weighted = odd.join(F.broadcast(hot), "h", "left").select("text", (1 / F.coalesce("copies", F.lit(1.0))).alias("weight"))  # at most HOT rows

    def rows(frame: pd.DataFrame) -> Iterable[tuple[str, float]]:
        return zip(frame["text"], frame["weight"], strict=True)

    def count_chars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            total.update(chars_of(rows(frame)))
        yield pd.DataFrame(list(total.items()), columns=["c", "n"])

    chars = weighted.mapInPandas(count_chars, "c string, n double").groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, COMMON * n))
    common = common_of({r["c"]: r["n"] for r in chars.collect()}, n)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS)

        def given(pair: list | np.ndarray, line: list, n: list | np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(line, pa.string()), pa.array(n, pa.float64())], names=["pair", "line", "n"])

        for batch in batches:
            pairs, lines = pairs_of(zip(*(c.to_pylist() for c in batch.columns), strict=True), common)
            total += pairs
            yield given([-1] * len(lines), list(lines), list(lines.values()))
        at = np.flatnonzero(total)
        yield given(at, [None] * len(at), total[at])

    both = weighted.mapInArrow(count_pairs, "pair int, line string, n double").groupBy("pair", "line").agg(F.sum("n").alias("n"))
    least = F.when(F.col("pair") >= 0, max(2, OFTEN * n)).otherwise(max(3, SHARED * n))
    pairs, lines = np.zeros(PAIRS), {}
    for r in both.filter(F.col("n") >= least).toLocalIterator():
        if r["pair"] >= 0:
            pairs[r["pair"]] = r["n"]
        else:
            lines[r["line"]] = r["n"]
    return counts_of(pairs, lines, common, n)


def correct_segments(texts: list[str], counts: Counts) -> dict[str, int]:
    """Distinct sentences (digits masked) of common characters, and shared lines of symbols, with their numbers of texts."""
    out: Counter = Counter()
    for t in dict.fromkeys(texts):
        for s in sentences(t):
            if s in counts.lines or ({c for c in s if ord(c) > 126} <= counts.common and not looks_utf8(s, counts.common)):
                out[s] += 1
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def train(texts: list[str], langs: list[str | None] | None = None, counts: Counts | None = None) -> Model:
    """The classifier from a bounded sample of texts; no garbled text needs to be labelled.

    counts are those of the whole corpus; without them the texts are the corpus.

    Correct text is one class per stated language, so that a language does not
    look like a chain that hardly changes it.
    """
    corpus = counts or count_texts(texts)
    counted = correct_segments(texts, corpus)
    segments = list(counted)
    language: dict[str, Counter] = {}
    for t, lang in zip(texts, langs or [None] * len(texts), strict=True):
        for s in _BREAK.split(t)[::2]:
            language.setdefault(re.sub(r"\d+", "0", s), Counter())[str(lang).lower()[:2]] += 1
    if len(segments) > SAMPLE_SEGMENTS:
        step = len(segments) / SAMPLE_SEGMENTS
        segments = [segments[int(i * step)] for i in range(SAMPLE_SEGMENTS)]

    def count(rows: list[str]) -> np.ndarray:
        own = [bigrams(s) for s in rows]
        return np.bincount(np.concatenate(own), minlength=BUCKETS) if own else np.zeros(BUCKETS, int)

    classes: list[tuple[tuple[str, str], ...]] = []
    hits: list[np.ndarray] = []
    for chain in chains():
        c = count([g for s in segments if (g := garble(s, chain)) is not None])
        if c.sum():
            classes.append(chain)
            hits.append(c)
    spoken: dict[str, list[str]] = {}
    for s in segments:
        spoken.setdefault(language[s].most_common(1)[0][0], []).append(s)
    hits += [count(segments), *(count(rows) for _, rows in sorted(spoken.items()))]
    table = np.stack(hits).astype(np.float64)
    share = table / np.maximum(table.sum(1, keepdims=True), 1)
    # equal mass per class, so a pair that no class knows speaks for none
    mass = 2e4
    log_p = np.log((share * mass + SMOOTH) / (mass + SMOOTH * BUCKETS)).astype(np.float32)
    letters = frozenset(x for c in corpus.common if c.isalpha() for x in (c, c.lower(), c.upper()) if len(x) == 1) | TYPOGRAPHIC
    return Model(classes, log_p, corpus.known, corpus.rate, table[: len(classes)] > 0, letters)


def scores(model: Model, segments: list[str]) -> np.ndarray:
    """Log odds of each chain against correct text of the likeliest language, one row per segment."""
    idx = [bigrams(s) for s in segments]
    sizes = np.array([len(x) for x in idx])
    out = np.zeros((len(segments), len(model.log_p)), np.float32)
    full = np.flatnonzero(sizes)
    for start in range(0, len(full), 256):
        part = full[start : start + 256]
        flat = np.concatenate([idx[i] for i in part])
        offsets = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        out[part] = np.add.reduceat(model.log_p.T[flat], offsets, axis=0)
    n = len(model.chains)
    return out[:, :n] - out[:, n:].max(1, keepdims=True)


def _known(model: Model, text: str) -> float:
    b = char_pairs(text)
    return float(model.known[b].mean()) if len(b) else 1.0


def one_script(text: str) -> bool:
    """False for a few Cyrillic letters among Latin ones, which no correct sentence has."""
    cyrillic = len(re.findall(r"[\u0400-\u04ff]", text))
    return not 0 < cyrillic < 0.3 * (cyrillic + len(re.findall(r"[A-Za-z\u00c0-\u024f]", text)))


def fluency(model: Model, text: str) -> float:
    """Log likelihood of the character pairs outside ASCII as correct text."""
    return float(model.rate[char_pairs(text)].sum())


def multibyte_words(model: Model, segment: str) -> str | None:
    """The sentence with UTF-8 runs read one byte at a time undone, where the rest of it hides them from the classifier.

    A run counts if correct text hardly has its byte pairs and it stands for
    letters or signs that correct text has, in either case.
    """

    def undo(m: re.Match) -> str:
        for read in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"):
            back = invert(m[0], (("utf-8", read),))
            if back is not None and len(back) < len(m[0]) and set(back) <= model.letters and _known(model, m.string[max(0, m.start() - 1) : m.end() + 1].strip()) < 0.9:
                return back
        return m[0]

    out = re.sub(r"[^\x00-\x7f]{2,}", undo, segment)
    return out if out != segment else None


def views(segment: str) -> set[str]:
    """The sentence and its plain forms: capitals, composed letters and kinds of space are no garbling."""
    plain = re.sub(r"[\u00a0\u2000-\u200a\u202f]", " ", re.sub(r"[\u200b-\u200d\u00ad]", "", unicodedata.normalize("NFC", segment)))
    return {segment, plain, plain.lower()}


def word_options(model: Model, word: str) -> dict[int, tuple[str, float]]:
    """Chain to (word before it, log likelihood gained) of those that make the word known better than any of its views."""
    found = model.words.get(word)
    if found is None:
        if len(model.words) > HELD_WORDS:
            model.words.clear()
        found = model.words[word] = {}
        known = max(_known(model, x) for x in views(word))
        if known < 1:
            fluent = fluency(model, word)
            for c, back in invert_all(word, model.chains):
                if _known(model, back) >= max(KNOWN, known + BETTER):
                    found[c] = (back, fluency(model, back) - fluent)
    return found


def gain(odds: float) -> float:
    return GAIN if odds > PRIOR else UNLIKELY


def restore_segment(model: Model, segment: str, odds: np.ndarray) -> tuple[str, str | None, bool]:
    """(text, chain or None, garbled) of one sentence."""
    order = np.argsort(-odds).tolist()
    before, fluent = max(_known(model, x) for x in views(segment)), max(fluency(model, x) for x in views(segment))
    if before >= 1:
        return segment, None, False
    fits = []
    for c, back in invert_all(segment, model.chains):
        if LOST not in back and _known(model, back) >= max(KNOWN, before + BETTER) and one_script(back):
            fluency_after = fluency(model, back)
            if fluency_after >= fluent + gain(odds[c]):
                fits.append((fluency_after + float(odds[c]), -c, back, c))
    if fits:
        _, _, back, c = max(fits)
        return back, "+".join(f"{w}>{r}" for w, r in model.chains[c]), True
    # characters were lost, or only some words are garbled: word by word
    words = re.split(r"( +)", segment)
    options = {i: own for i, w in enumerate(words) if not w.isascii() and (own := word_options(model, w))}
    for c in order if options else ():
        backs = list(words)
        for i, own in options.items():
            if c in own and own[c][1] >= gain(odds[c]):
                backs[i] = own[c][0]
        if backs != words and one_script("".join(backs)):
            return "".join(backs), "+".join(f"{w}>{r}" for w, r in model.chains[c]) + " in part", True
    best = order[0]
    if odds[best] >= SURE and model.seen[best][bigrams(segment)].mean() >= 0.9 and before < 0.9 and not _DRAWN.match(re.sub(r"[\x00-\x7f]", "", segment)):
        return segment, "+".join(f"{w}>{r}" for w, r in model.chains[best]) + " lost", True
    back = multibyte_words(model, segment)
    return back or segment, "utf-8 in part" if back else None, back is not None


def unknown_segments(model: Model, segments: list[str]) -> list[str]:
    """Those with a character pair that correct text does not have, in any of their views."""
    out = []
    for start in range(0, len(segments), 4096):
        part = segments[start : start + 4096]
        encoded = [f" {s} ".encode("utf-32-le", "surrogatepass") for s in part]
        ends = np.cumsum([len(e) // 4 for e in encoded])
        c = np.frombuffer(b"".join(encoded), np.uint32).astype(np.int64)
        bad = np.flatnonzero(((c[:-1] | c[1:]) > 126) & ~model.known[_hash_pairs(c)])
        out += [part[i] for i in np.unique(np.searchsorted(ends, bad, side="right"))]
    return [s for s in out if all(_known(model, x) < 1 for x in views(s))]


def restore_texts(model: Model, texts: list[str]) -> list[tuple[str, list[str], bool]]:
    """(restored, chains, garbled) of whole texts; a sentence that several have is judged once."""
    split = [_BREAK.split(t) if not t.isascii() else [t] for t in texts]
    every = list(dict.fromkeys(s for parts in split for s in parts[::2] if not s.isascii()))
    odd = unknown_segments(model, every)
    judged = {s: restore_segment(model, s, odds) for s, odds in zip(odd, scores(model, odd), strict=True)} if odd else {}
    out = []
    for text, parts in zip(texts, split, strict=True):
        used, garbled = set(), LOST in text
        for i in range(0, len(parts), 2):
            if (hit := judged.get(parts[i])) is not None:
                parts[i], chain, bad = hit
                garbled |= bad
                if chain:
                    used.add(chain)
        out.append(("".join(parts), sorted(used), garbled))
    return out


def restore_text(model: Model, text: str) -> tuple[str, list[str], bool]:
    """(restored, chains, garbled) of a whole text."""
    return restore_texts(model, [text])[0]


def fit(documents: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Counts over all documents, and trains on the ``sample`` documents of lowest id hash, of at most SAMPLE_CHARS characters."""
    counts = count_corpus(documents)
    rows = documents.filter(F.length("text") <= SAMPLE_CHARS).select("text", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h")).orderBy("h", "text").limit(sample).collect()  # bounded by sample
    return train([r["text"] for r in rows], [r["lang"] for r in rows], counts)


def restore(spark: SparkSession, documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, restored, chains, lost) of the documents that were decoded wrongly, wholly or in part.

    lost says that characters cannot be had back: U+FFFD, or sentences whose
    chain is known but does not invert.  Null and empty texts are correct.  A
    text is read whole, sentence by sentence; different sentences may have
    different chains.  An empty table gives no row.
    """
    shared = spark.sparkContext.broadcast(model or fit(documents))  # about 20 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for part in chunks(texts):
                found = [(i, *x) for i, x in zip(ids[part], restore_texts(m, texts[part]), strict=True) if x[2]]
                lost = [LOST in restored or any(u.endswith("lost") for u in used) for _, restored, used, _ in found]
                columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array(lost, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "restored", "chains", "lost"])

    suspects = documents.select("doc_id", "text").filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    return suspects.mapInArrow(run, "doc_id long, restored string, chains array<string>, lost boolean")
