"""Checks of splits, locks, shards and migrations: one row per check, with what fails it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("train", "dev", "lock", "heldout", "ungrouped")


def failing(name: str, rows: DataFrame) -> DataFrame:
    """check, failures of the rows that fail it."""
    return rows.agg(F.lit(name).alias("check"), F.count("*").alias("failures"))


def report(*checks: DataFrame) -> DataFrame:
    """check, failures, ok of several."""
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("failures") == 0)


def check_splits(rows: DataFrame, main_only: tuple[str, ...] = (), taxon_sets: tuple[str, ...] = ("crops",)) -> DataFrame:
    """check, failures, ok of labelled records (set, key, source, grp, before, label, heldout).

    counts_unchanged: dev and ungrouped records by set are what they were;
    groups_apart: no group of a source is in both train and lock; heldout_apart:
    no record of a held-out genus is train, in the sets that have taxa;
    keys_agree: a key has one label over these sets; main_sources_apart: no
    record of the sources ``main_only`` is train; keys_once: a key occurs once
    in a set.  A null group is none.
    """
    kept = lambda c: F.count(F.when(F.col(c).isin("dev", "ungrouped"), 1))
    moved = rows.groupBy("set", "before").agg(kept("before").alias("a")).filter(F.col("before").isin("dev", "ungrouped")).withColumnRenamed("before", "l")
    now = rows.groupBy("set", "label").agg(kept("label").alias("b")).filter(F.col("label").isin("dev", "ungrouped")).withColumnRenamed("label", "l")
    changed = moved.join(now, ["set", "l"], "full_outer").filter(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0)))
    named = rows.filter("grp is not null and grp <> ''")
    both = named.groupBy("source", "grp").agg(F.max((F.col("label") == "train").cast("int")).alias("t"), F.max((F.col("label") == "lock").cast("int")).alias("k")).filter("t = 1 and k = 1")
    taxa = rows.filter(F.col("set").isin(*taxon_sets))
    return report(
        failing("counts_unchanged", changed), failing("groups_apart", both), failing("heldout_apart", taxa.filter(F.col("heldout") & (F.col("label") == "train"))),
        failing("keys_agree", taxa.groupBy("key").agg(F.count_distinct("label").alias("n")).filter("n > 1")), failing("main_sources_apart", rows.filter(F.col("source").isin(*main_only) & (F.col("label") == "train"))),
        failing("keys_once", rows.groupBy("set", "key").agg(F.count("*").alias("n")).filter("n > 1")),
    )


def check_partitions(crops: DataFrame, background: DataFrame) -> DataFrame:
    """check, failures, ok: backgrounds (key, grp, label) against the crops (grp, label) of their deployment.

    known: the deployment has crops; same_side: they lie on the background's
    side, where train and heldout are one side (the pool) and lock the other.
    """
    side = F.when(F.col("label").isin("train", "heldout"), "pool").when(F.col("label") == "lock", "lock")
    held = crops.withColumn("side", side).filter("side is not null").groupBy("grp").agg(F.count_distinct("side").alias("sides"), F.min("side").alias("crop_side"))
    own = background.withColumn("side", side).filter("side is not null").join(held, "grp", "left")
    return report(failing("known", own.filter("crop_side is null")), failing("same_side", own.filter("sides > 1 or crop_side <> side")))


def off_fraction(groups: DataFrame, stratum: str, picked: Column, fraction: float) -> DataFrame:
    """stratum, groups, picked, due of the strata whose number of picked groups is not rint(fraction * groups)."""
    per = groups.groupBy(stratum).agg(F.count("*").alias("groups"), F.count(F.when(picked, 1)).alias("picked"))
    return per.withColumn("due", F.rint(F.col("groups") * fraction).cast("long")).filter("picked <> due")


def lock_requirements(units: DataFrame, k: int, more_k: int, q: int, bars: dict[str, tuple]) -> DataFrame:
    """requirement, value, ok of a lock cut on units (source, species, genus, grp, side, unseen).

    side is lock or pool, unseen says that the genus is held out.  R1: species of
    the first source usable at k in the lock, genera with two of these, species
    usable at more_k.  R2: unseen species usable at k, and of these those of the
    second source.  R3: species of the third source usable at k in its lock.
    R4: units of the first source's pool outside unseen genera.  R5: its share
    of units in the lock, between two bars.  bars: source names under
    ``sources``, and what R1 to R5 must reach.
    """
    first, second, third = bars["sources"]

    def usable(rows: DataFrame, bar: int) -> DataFrame:
        per = rows.groupBy("species", "genus", "grp").agg(F.count("*").alias("n")).groupBy("species", "genus").agg(F.sum("n").alias("t"), F.max("n").alias("m"))
        return per.filter((F.col("t") >= bar + q) & (F.col("t") - F.col("m") >= q))

    named = units.filter("species is not null")
    lock = named.filter((F.col("source") == first) & (F.col("side") == "lock"))
    at_k = usable(lock, k)
    genera = at_k.filter("genus is not null").groupBy("genus").agg(F.count("*").alias("n")).filter("n >= 2")
    unseen = usable(named.filter((F.col("source") == first) & F.col("unseen")), k)
    seen_elsewhere = usable(named.filter(F.col("source") == second), k).join(unseen.select("species"), "species", "left_semi")
    of_third = usable(named.filter((F.col("source") == third) & (F.col("side") == "lock")), k)
    own = named.filter(F.col("source") == first)
    count = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("requirement"), "value")
    values = [
        (count(at_k, "R1 species"), bars["R1"][0], None), (count(genera, "R1 genera"), bars["R1"][1], None), (count(usable(lock, more_k), "R1 species at more"), bars["R1"][2], None), (count(unseen, "R2 unseen"), bars["R2"][0], None),
        (count(seen_elsewhere, "R2 unseen elsewhere"), bars["R2"][1], None), (count(of_third, "R3"), bars["R3"][0], None), (count(own.filter("side <> 'lock' and not unseen"), "R4"), bars["R4"][0], None),
        (own.agg(F.round(F.avg((F.col("side") == "lock").cast("double")), 4).alias("value")).select(F.lit("R5").alias("requirement"), "value"), bars["R5"][0], bars["R5"][1]),
    ]
    return reduce(DataFrame.unionByName, [v.withColumn("ok", (F.coalesce("value", F.lit(0.0)) >= low) & (F.lit(True) if high is None else F.col("value") <= high)) for v, low, high in values])


def verify_shards(expected: DataFrame, members: DataFrame, suffixes: tuple[str, str] = ("jpg", "json")) -> DataFrame:
    """check, failures, ok of built shards against what was to be built.

    expected: (key, source, size, digest); members: (archive, source, idx, key,
    ext, size, digest), a row per file in an archive.  pairs: every key of an
    archive has one file of each suffix; numbered: the archives of a source are
    numbered from 0 without gaps; once: a key lies in one archive; missing and
    extra: against the keys expected; placed: a key lies in its source's
    archive; size and digest: of the first suffix, where both sides state one.
    """
    per = members.groupBy("archive", "key").agg(*[F.count(F.when(F.col("ext") == s, 1)).alias(f"n{i}") for i, s in enumerate(suffixes)], F.count("*").alias("n"))
    numbers = members.select("source", "idx").distinct().groupBy("source").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    held = members.filter(F.col("ext") == suffixes[0]).groupBy("key").agg(F.count_distinct("archive").alias("archives"), F.min("source").alias("s"), F.min("size").alias("sz"), F.min("digest").alias("dg"))
    both = expected.join(held, "key")
    return report(
        failing("pairs", per.filter("n0 <> 1 or n1 <> 1 or n <> 2")), failing("numbered", numbers.filter("low <> 0 or high + 1 <> n")), failing("once", held.filter("archives > 1")),
        failing("missing", expected.join(held, "key", "left_anti")), failing("extra", held.join(expected, "key", "left_anti")), failing("placed", both.filter("source <> s")),
        failing("size", both.filter("size <> sz")), failing("digest", both.filter("digest <> dg")),
    )


def verify_store(expected: DataFrame, rows: DataFrame, dims: int, vector: str = "vector") -> DataFrame:
    """check, failures, ok of an embedding store (store, row, key, vector) against the keys due to each store.

    present and extra keys; once; rows numbered from 0 without gaps; vectors of
    ``dims`` numbers; finite; not all zero.
    """
    v = F.col(vector)
    numbers = rows.groupBy("store").agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.count_distinct("row").alias("d"))
    return report(
        failing("missing", expected.join(rows, ["store", "key"], "left_anti")), failing("extra", rows.join(expected, ["store", "key"], "left_anti")), failing("once", rows.groupBy("store", "key").agg(F.count("*").alias("n")).filter("n > 1")),
        failing("numbered", numbers.filter("low <> 0 or high + 1 <> n or d <> n")), failing("dims", rows.filter(F.coalesce(F.size(v), F.lit(-1)) != dims)), failing("finite", rows.filter(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))),
        failing("nonzero", rows.filter(F.forall(v, lambda x: x == 0))),
    )


def verify_migration(images: tuple[DataFrame, DataFrame], annotations: tuple[DataFrame, DataFrame], categories: tuple[DataFrame, DataFrame], remap: DataFrame) -> DataFrame:
    """check, failures, ok of a document before and after its categories were moved by remap (old, new).

    images_kept and annotations_kept: the same ids; others_kept: annotations of
    categories that do not move keep theirs; moved: the others have the new one;
    known: every category in use is there; gone: no category moved from is left;
    once: category ids are unique.
    """
    differ = lambda a, b, c: a.select(c).exceptAll(b.select(c)).unionByName(b.select(c).exceptAll(a.select(c)))
    (i0, i1), (a0, a1), (_, c1) = images, annotations, categories
    moves = remap.filter("old <> new").select(F.col("old").alias("category_id"), "new").distinct()
    pairs = a0.select("annotation_id", "category_id").join(a1.select("annotation_id", F.col("category_id").alias("now")), "annotation_id").join(moves, "category_id", "left")
    return report(
        failing("images_kept", differ(i0, i1, "image_id")), failing("annotations_kept", differ(a0, a1, "annotation_id")), failing("others_kept", pairs.filter("new is null and now <> category_id")), failing("moved", pairs.filter("new is not null and now <> new")),
        failing("known", a1.join(c1, "category_id", "left_anti")), failing("gone", c1.join(moves, "category_id", "left_semi")), failing("once", c1.groupBy("category_id").agg(F.count("*").alias("n")).filter("n > 1")),
    )


def blind_order(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """rows with index, from 1, in a reproducible random order that does not show where a row came from."""
    from tidemark.functions.text import hash_order
    from tidemark.operators.ranks import placed

    return placed(rows, [], [hash_order(F.lit(seed), F.col(key)), key], "index")


def sheet_scores(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """sheet, position, score, problem of scored grids against the pages that were handed out.

    cells: (sheet, scores array); pages: (sheet, position), from 1.  A position
    without a score, or beyond the page, is a problem; sheets that were not
    scored, or never handed out, show as such.
    """
    scored = cells.select("sheet", F.posexplode("scores").alias("p", "score")).select("sheet", (F.col("p") + 1).alias("position"), F.nullif(F.trim(F.col("score").cast("string")), F.lit("")).alias("score"))
    both = pages.withColumn("_due", F.lit(True)).join(scored.withColumn("_got", F.lit(True)), ["sheet", "position"], "full_outer")
    problem = F.when(F.col("_due").isNull() & F.col("score").isNotNull(), "not handed out").when(F.col("_due").isNotNull() & F.col("score").isNull(), "not scored")
    return both.filter(F.col("_due").isNotNull() | F.col("score").isNotNull()).select("sheet", "position", "score", problem.alias("problem"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (duplicates are dropped, the smallest order stays)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
