"""Mapping freely typed names to the entries of a reference list.

Method: distinct tokens of the typed names are joined to the list's vocabulary
by edit distance (equal deletion variants propose, the distance decides); the
repaired tokens are then combined by soft TF-IDF to rank complete entries.  An
entry counts if each of its words is borne out and its score, the cosine with
what was typed, reaches CUT.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import lookup_join
from tidemark.session import Scratch

# fixed values: letters of other scripts that look like Latin ones, and letters without a decomposition
LOOKALIKES = str.maketrans("асеорхуіјѕԁһкмтвнАСЕОРХУІЈЅКМТВНαονρτικøłđßæœıØŁĐ", "aceopxyijsdhkmtbhACEOPXYIJSKMTBHaovptikoldsaoiOLD")
# fixed values: words that qualify a name without being part of it
QUALIFIERS = frozenset(
    "sp spp ssp cf aff indet unid unidentified undet nr near juv juvenile juveniles adult adults male female m f distant far close school shoal group of pair several many few possible possibly probable probably maybe likely unsure gen nov var det "
    "species genus family fam ord large small big on in the at left right edge view blurred partial partly hidden and et al ex".split()
)
CUT = 0.8  # least cosine of a typed name and its entry
BORNE = 0.6  # similarity of a genus that only its initial or the genus column bears out
TRAILING = 0.01  # share that a further word has in the weight of a name whose species is complete (authors, places)
MIN_PREFIX = 4  # letters that a cut-off epithet must show


def fold(text: str) -> str:
    """Latin letters without accents; lookalikes of other scripts replaced."""
    text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
    return "".join(c for c in text if not unicodedata.combining(c))


def edits(length: int) -> int:
    """Edit distance allowed for a token of this length."""
    return 0 if length < 5 else 1 if length < 7 else 2


def variants(token: str) -> set[str]:
    """The token with up to edits(len) letters left out."""
    out = {token}
    for n in range(1, edits(len(token)) + 1):
        out |= {"".join(c for i, c in enumerate(token) if i not in gone) for gone in combinations(range(len(token)), n)}
    return out


def words(name: str | None) -> tuple[list[str], str, int]:
    """(tokens, initial, loose): lower-case words without qualifiers, numbers and brackets; an abbreviated genus; words that look like authors.

    Authors are capitalised words after the first one where a year or ``&``
    stands, in a name that is not all capitals.
    """
    text = fold(name or "")
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]|\([^)]*$", " ", text)
    shouted = text.upper() == text
    authored = bool(re.search(r"\b1[5-9]\d\d\b|\b20\d\d\b|&", text)) and not shouted
    if not shouted:
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    initial = ""
    if (m := re.match(r"[^A-Za-z]*([A-Za-z]{1,6})\.\s+(?=[A-Za-z]{3})|[^A-Za-z]*([A-Za-z])\.(?=[A-Za-z]{3})", text)) and (m[1] or m[2]).lower() not in QUALIFIERS - {"f", "m"}:
        initial, text = (m[1] or m[2]).lower(), text[m.end() :]
    tokens, loose = [], 0
    for i, w in enumerate(re.findall(r"[A-Za-z0-9]+", text)):
        low = w.lower()
        if low.isdigit() or low in QUALIFIERS or len(low) < 2:
            continue
        if authored and i and w[0].isupper():
            loose += 1
        tokens.append(low)
    return tokens, initial, loose


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for name_id, name, genus, species in zip(frame["name_id"], frame["proposed_name"], frame["genus"], frame["species"], strict=True):
            typed = name if isinstance(name, str) and name.strip().upper() not in ("", "NA", "N/A", "NAN", "NULL", "NONE") else None
            if typed is None:
                g, s = (x if isinstance(x, str) else "" for x in (genus, species))
                first = words(g)[0][:1]
                typed = s if first and first[0] in words(s)[0] else f"{g} {s}"
            tokens, initial, loose = words(typed)
            hint = words(genus if isinstance(genus, str) else "")[0][:1]
            for pos, t in enumerate(tokens):
                rows.append((name_id, pos, t, initial, len(tokens) - loose, hint[0] if hint else ""))
            if len(tokens) == 2 and not initial:  # one word torn in two
                rows.append((name_id, 99, "".join(tokens), initial, len(tokens) - loose, hint[0] if hint else ""))
        yield pd.DataFrame(rows, columns=["name_id", "pos", "token", "initial", "content", "hint"])


def entry_words(reference: DataFrame) -> DataFrame:
    """(form, aphia_id, kind, slot, word, n_words, head): each entry's words, of its name and of its vernacular.

    kind is Species, Genus, Family or vernacular; a species also has the kind
    joined, of its words as one.
    """

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for aphia, name, rank, vernacular in zip(frame["aphia_id"], frame["valid_name"], frame["taxon_rank"], frame["vernacular"], strict=True):
                own = re.findall(r"[a-z0-9]+", fold(name or "").lower())
                common = re.findall(r"[a-z0-9]+", fold(vernacular if isinstance(vernacular, str) else "").lower())
                listed = [(str(rank), own), ("vernacular", common)] + ([("joined", ["".join(own)])] if len(own) > 1 else [])
                for kind, ws in listed:
                    rows += [(f"{aphia}-{kind}", int(aphia), kind, slot, w, len(ws), own[0] if own else "") for slot, w in enumerate(ws)]
            yield pd.DataFrame(rows, columns=["form", "aphia_id", "kind", "slot", "word", "n_words", "head"])

    named = reference.filter("aphia_id is not null and valid_name is not null").select("aphia_id", "valid_name", "taxon_rank", "vernacular")
    return named.mapInPandas(forms, "form string, aphia_id long, kind string, slot int, word string, n_words int, head string")


def repair(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): vocabulary words within edits(len) of each distinct token, also those it is cut off from.

    tokens and vocabulary have distinct token and word.  Tokens and words with a
    common deletion variant meet in an equi-join, the edit distance decides, so
    no pair within the distance is lost and no cross join is formed.
    """
    schema = "token string, variant long"  # hashed: the distance decides in any case
    # a token longer than every word by more than the distance is within it of none
    longest = (vocabulary.agg(F.max(F.length("word"))).head()[0] or 0) + edits(99)

    def delete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(t, xxhash.xxh64_intdigest(v) - (1 << 63)) for t in frame["token"] for v in (variants(t) if len(t) <= longest else (t,))]
            yield pd.DataFrame(rows, columns=["token", "variant"])

    # a row gives hundreds of variants, so tasks follow the cores; by another hash than the tokens lie by, or Spark leaves them as they are
    tasks = 2 * tokens.sparkSession.sparkContext.defaultParallelism
    left = tokens.select("token").repartition(tasks, F.xxhash64("token")).mapInPandas(delete, schema)
    right = vocabulary.select(F.col("word").alias("token")).repartition(tasks, F.xxhash64("token")).mapInPandas(delete, schema).withColumnRenamed("token", "word")
    near = left.join(right, "variant").select("token", "word").distinct()
    far = F.levenshtein("token", "word")
    longer = F.greatest(F.length("token"), F.length("word"))
    allowed = F.when(longer < 5, 0).when(longer < 7, 1).otherwise(2)
    close = near.filter(far <= allowed).select("token", "word", (1 - far / longer).alias("sim"))
    heads = vocabulary.filter(F.length("word") > MIN_PREFIX).select("word", F.explode(F.transform(F.sequence(F.lit(MIN_PREFIX), F.length("word") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("token"))
    cut = tokens.select("token").join(heads, "token").select("token", "word", (F.lit(0.5) + F.length("token") / F.length("word") / 4).alias("sim"))
    return close.unionByName(cut).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def map_names(spark: SparkSession, typed: DataFrame, reference: DataFrame) -> DataFrame:
    """(map_id, aphia_id, valid_name, score, status) for each map_id of typed without aphia_id.

    The name is proposed_name, or genus and species where that is missing.  Every
    word of an entry must be borne out by a typed word of its own, the genus of a
    species also by its initial or the genus column; typed words that no word of
    the entry explains weigh against it.  Below CUT, as for no name at all,
    aphia_id is 0 and status ``unmatched``.  Ties go to the smaller aphia_id.
    Repeats of a map_id count once, a null map_id is left out; empty tables give
    no row.
    """
    scratch = Scratch(spark, "names")
    todo = typed.filter("aphia_id is null and map_id is not null").groupBy("map_id").agg(F.min(F.struct("proposed_name", "genus", "species")).alias("n")).select("map_id", "n.*")
    todo = scratch.save(todo.withColumn("name_id", F.xxhash64(*[F.coalesce(c, F.lit("\u0001")) for c in ("proposed_name", "genus", "species")])), "todo")  # a null has its own place
    names = todo.select("name_id", "proposed_name", "genus", "species").dropDuplicates(["name_id"])
    tokens = scratch.save(names.mapInPandas(_split, "name_id long, pos int, token string, initial string, content int, hint string"), "tokens")
    forms = scratch.save(entry_words(reference), "forms")
    hints = tokens.filter("hint <> ''").select(F.col("hint").alias("token"))
    repaired = scratch.save(repair(tokens.select("token").unionByName(hints).distinct(), forms.select("word").distinct()), "repaired")

    n_forms = max(1, forms.select("form").distinct().count())
    weights = forms.groupBy("word").agg(F.log(1 + F.lit(float(n_forms)) / F.count_distinct("form")).alias("idf"))
    postings = forms.join(weights, "word")
    norms = postings.groupBy("form").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("form_norm"))
    unknown = math.log(1 + n_forms)
    evidence = tokens.join(repaired, "token").withColumn("cut", F.length("word") - F.length("token") > 2)
    # a cut-off token may stand for an epithet only; a torn word for a joined form only
    may = ((F.col("pos") < 99) | (F.col("kind") == "joined")) & (~F.col("cut") | ((F.col("kind") == "Species") & (F.col("slot") > 0)))
    # an entry is met through the rarest of the words that it cannot do without, so a common genus brings no list of species
    needed = postings.filter((F.col("kind") != "Species") | (F.col("n_words") == 1) | (F.col("slot") > 0))
    anchors = needed.withColumn("rn", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("idf"), "slot"))).filter("rn = 1").drop("rn")
    met = evidence.join(anchors.select("form", "word", "kind", "slot"), "word").filter(may).select("name_id", "form").distinct()
    hit = met.join(postings, "form").join(evidence, ["name_id", "word"]).filter(may)
    near = -F.abs(F.col("pos") - F.col("slot"))
    best = hit.groupBy("name_id", "form", "slot").agg(F.max(F.struct("sim", "idf", near.alias("near"), "pos")).alias("b"), *[F.first(c).alias(c) for c in ("aphia_id", "kind", "n_words", "head", "initial", "content", "hint")])
    square = F.col("b.idf") * F.col("b.idf")
    scored = best.groupBy("name_id", "form").agg(
        *[F.first(c).alias(c) for c in ("aphia_id", "kind", "n_words", "head", "initial", "content", "hint")],
        F.count("*").alias("covered"), F.sum(F.when(F.col("b.pos") == 99, 2).otherwise(1)).alias("words"), F.count_distinct("b.pos").alias("used"), F.max(F.when(F.col("slot") == 0, 1).otherwise(0)).alias("has_head"),
        F.sum(F.col("b.sim") * square).alias("dot"), F.sum(F.col("b.sim") * F.col("b.sim") * square).alias("own"), F.min("b.sim").alias("least"),
    )
    genus_hint = repaired.select(F.col("token").alias("hint"), F.col("word").alias("head"), F.lit(True).alias("hinted"))
    heads = weights.select(F.col("word").alias("head"), (F.col("idf") * F.col("idf")).alias("head_square"))
    scored = scored.join(genus_hint, ["hint", "head"], "left").join(heads, "head", "left").join(norms, "form")
    hinted = F.coalesce("hinted", F.lit(False))
    by_initial = (F.col("initial") != "") & F.col("head").startswith(F.col("initial"))
    borne = (F.col("kind") == "Species") & (F.col("n_words") > 1) & (F.col("has_head") == 0) & (by_initial | (F.col("initial") == "") & hinted)
    whole = (F.col("covered") + borne.cast("int") == F.col("n_words")) & (F.col("used") == F.col("covered"))
    extra = F.greatest(F.col("content") - F.col("words"), F.lit(0)) + ((F.col("initial") != "") & ~borne & ~(by_initial & (F.col("kind") == "Species"))).cast("int")
    weigh = F.when((F.col("kind") == "Species") & (F.col("n_words") > 1) & ~borne, TRAILING).otherwise(1.0)
    head = F.when(borne, F.coalesce("head_square", F.lit(0.0))).otherwise(0.0)
    cosine = (F.col("dot") + BORNE * head) / (F.col("form_norm") * F.sqrt(F.col("own") + BORNE * BORNE * head + extra * weigh * F.lit(unknown * unknown)))
    fits = scored.filter(whole).withColumn("score", F.round(cosine, 6)).filter(F.col("score") >= CUT)
    # of entries as close in their words, the one whose words were typed as they are, then the one whose genus the row names
    order = (F.desc(F.round(F.col("score") * F.col("dot") / (F.col("form_norm") * F.col("form_norm")) + F.when(hinted, 0.01).otherwise(0.0), 6)), F.desc("covered"), "aphia_id")
    ranked = fits.withColumn("rn", F.row_number().over(Window.partitionBy("name_id").orderBy(*order)))
    chosen = ranked.filter("rn = 1").select("name_id", F.col("aphia_id").alias("found"), "score", "least")
    valid = reference.select(F.col("aphia_id").alias("found"), "valid_name").dropDuplicates(["found"])
    # one name may be typed in a third of all rows
    named = scratch.save(lookup_join(chosen, valid, ["found"]), "named")
    out = lookup_join(todo.select("map_id", "name_id"), named, ["name_id"], "left")
    status = F.when(F.col("found").isNull(), "unmatched").when(F.col("least") == 1, "exact").otherwise("repaired")
    return out.select("map_id", F.coalesce("found", F.lit(0).cast("long")).alias("aphia_id"), "valid_name", "score", status.alias("status"))
