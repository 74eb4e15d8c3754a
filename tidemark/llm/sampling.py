"""Reproducible samples that stay stable as data grows.

A ledger keeps every key ever selected per seed.  A later run keeps the ledger's
keys that still exist (by join) and fills the growth of its quota with the
unseen keys of lowest hash priority.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import crop_name, hash_order
from tidemark.session import Kept, Scratch

BUCKETS = 1 << 16


def ledger(selections: DataFrame) -> DataFrame:
    """(seed, run_no, crop_key): recorded selections, each once, keys spelled as stored."""
    return selections.select("seed", "run_no", crop_name("crop_key").alias("crop_key")).filter("seed is not null and run_no is not null and crop_key is not null").distinct()


def population(crops: DataFrame) -> DataFrame:
    """(name, crop_key, added): each distinct key with its first time, in microseconds."""
    added = F.unix_micros(F.col("added_at").cast("timestamp"))
    return crops.filter("crop_key is not null").groupBy(crop_name("crop_key").alias("name")).agg(F.min("crop_key").alias("crop_key"), F.min(added).alias("added"))


def priority(seed: str, key: str):
    """First 60 bits of the SHA-256 of seed and key."""
    return F.conv(F.substring(hash_order(F.col(seed), F.col(key)), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Sample:
    """What one run draws: a share of the keys known by ``upto`` (microseconds; None for all)."""

    seed: int
    run_no: int
    frac: float
    upto: int | None = None


def draws(spark: SparkSession, keys: DataFrame, kept: DataFrame, samples: list[Sample]) -> DataFrame:
    """(seed, run_no, crop_key, kept): for each sample rint(frac * n) of its keys, never fewer than those kept.

    keys has distinct crop_key, and added where a sample has ``upto``; kept
    (seed, run_no, crop_key) is what the ledger held before that run.  All kept
    keys that exist stay, also beyond the quota; unseen keys join by lowest
    priority, the first 60 bits of SHA-256 of seed and key.  Keys are first
    cut at a priority that holds the quota with certainty enough, which is
    counted and raised if it did not; the exact cut comes from counts of 2**16
    hash ranges, so no task sorts more than one range.  Ties go to the smaller key.
    """
    scratch = Scratch(spark, "sample")
    stay = scratch.save(kept.select("seed", "run_no", "crop_key").distinct().join(keys.select("crop_key"), "crop_key").select("seed", "run_no", "crop_key"), "stay")
    if not samples:
        return stay.withColumn("kept", F.lit(True))
    known = lambda x: F.lit(True) if x.upto is None else F.coalesce(F.col("added") <= x.upto, F.lit(True))
    sizes = keys.agg(*[F.count_if(known(x)).alias(f"n{i}") for i, x in enumerate(samples)]).head()  # one row
    held = {(r["seed"], r["run_no"]): r["n"] for r in stay.groupBy("seed", "run_no").agg(F.count("*").alias("n")).collect()}  # one row per recorded run
    quota = {x: max(0, int(round(x.frac * sizes[f"n{i}"])) - held.get((x.seed, x.run_no), 0)) for i, x in enumerate(samples)}
    limit = {x: min(1.0, x.frac + 6 * (x.frac / max(1, sizes[f"n{i}"])) ** 0.5 + 64 / max(1, sizes[f"n{i}"])) for i, x in enumerate(samples)}
    marked, todo, step = None, [x for x in samples if quota[x]], 0
    while todo:
        wanted = [F.struct(F.lit(x.seed).cast("long").alias("seed"), F.lit(x.run_no).alias("run_no"), F.lit(int(limit[x] * (1 << 60))).cast("long").alias("limit"), known(x).alias("known")) for x in todo]
        near = keys.select("crop_key", F.inline(F.array(*wanted))).filter("known").withColumn("priority", priority("seed", "crop_key")).filter("priority < limit")
        near = near.join(stay, ["seed", "run_no", "crop_key"], "left_anti").withColumn("bucket", F.shiftright("priority", 44).cast("int"))
        near = scratch.save(near.select("seed", "run_no", "crop_key", "priority", "bucket"), f"near-{step}")
        met = {(r["seed"], r["run_no"]): r["n"] for r in near.groupBy("seed", "run_no").agg(F.count("*").alias("n")).collect()}  # one row per sample
        short = [x for x in todo if met.get((x.seed, x.run_no), 0) < quota[x] and limit[x] < 1]
        for x in short:
            limit[x] = min(1.0, 2 * limit[x])
        again = F.lit(False)
        for x in short:
            again |= (F.col("seed") == x.seed) & (F.col("run_no") == x.run_no)
        near = near.filter(~again)
        marked = near if marked is None else marked.unionByName(near)
        todo, step = short, step + 1
    own = stay.withColumn("kept", F.lit(True))
    if marked is None:
        return own
    bars = spark.createDataFrame([(x.seed, x.run_no, n) for x, n in quota.items()], "seed long, run_no int, quota long")
    ranges = marked.groupBy("seed", "run_no", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("seed", "run_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cuts = ranges.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(bars), ["seed", "run_no"]).filter("before < quota")
    fresh = marked.join(F.broadcast(cuts), ["seed", "run_no", "bucket"])  # at most BUCKETS rows per sample
    whole = fresh.filter("before + c <= quota").select("seed", "run_no", "crop_key")
    partial = fresh.filter("before + c > quota")  # one range per sample
    order = Window.partitionBy("seed", "run_no").orderBy("priority", "crop_key")
    edge = partial.withColumn("rn", F.row_number().over(order)).filter("rn <= quota - before").select("seed", "run_no", "crop_key")
    return own.unionByName(whole.unionByName(edge).withColumn("kept", F.lit(False)))


def draw(spark: SparkSession, keys: DataFrame, kept: DataFrame, frac: dict[int, float]) -> DataFrame:
    """(seed, crop_key, kept): one sample per seed, after what ``kept`` (seed, crop_key) holds."""
    return draws(spark, keys, kept.withColumn("run_no", F.lit(0)), [Sample(s, 0, f) for s, f in frac.items()]).drop("run_no")


def recorded_runs(selections: DataFrame) -> list[Sample]:
    """The recorded runs in order, with the largest fraction and latest time that their rows state; one per seed and run."""
    at = F.max(F.unix_micros(F.col("drawn_at").cast("timestamp"))).alias("upto")
    rows = selections.filter("seed is not null and run_no is not null").groupBy("seed", "run_no").agg(F.max("frac").alias("frac"), at).collect()  # one row per recorded run
    return sorted((Sample(r["seed"], r["run_no"], r["frac"] or 0.0, r["upto"]) for r in rows), key=lambda x: (x.seed, x.run_no))


def lost(spark: SparkSession, selections: DataFrame, crops: DataFrame) -> DataFrame:
    """(seed, crop_key): keys of some run of a seed that a later run of it lacks although they still exist.

    Every recorded run is drawn again from the ledger of the runs before it;
    what such a sample keeps and the recorded run lacks is lost.  Key spelling
    and repeats do not count; empty tables give no row.
    """
    scratch = Scratch(spark, "lost")
    entries = scratch.save(ledger(selections), "ledger")
    people = scratch.save(population(crops), "keys")
    runs = recorded_runs(selections)
    later = spark.createDataFrame([(x.seed, x.run_no, y.run_no) for x in runs for y in runs if x.seed == y.seed and x.run_no < y.run_no], "seed long, run_no int, next int")  # pairs of recorded runs
    before = entries.join(F.broadcast(later), ["seed", "run_no"]).select("seed", F.col("next").alias("run_no"), F.col("crop_key").alias("name")).distinct()
    kept = before.join(people.select("name", "crop_key"), "name").select("seed", "run_no", "crop_key")
    drawn = draws(spark, people.select("crop_key", "added"), kept, [x for x in runs if x.run_no > min(y.run_no for y in runs if y.seed == x.seed)])
    had = entries.join(people.withColumnRenamed("crop_key", "own"), entries["crop_key"] == people["name"]).select("seed", "run_no", F.col("own").alias("crop_key"))
    return drawn.filter("kept").join(had, ["seed", "run_no", "crop_key"], "left_anti").select("seed", "crop_key").distinct()


def next_run(spark: SparkSession, crops: DataFrame, kept: Kept, frac: dict[int, float], upto: int | None = None) -> DataFrame:
    """(seed, run_no, crop_key): the kept ledger after one more run per seed over the keys known by ``upto``; the new picks are written to it.

    The ledger (seed, run_no, crop_key; one row per key ever picked, with its
    first run) is the table that ``kept`` names; a first run starts it.  A key
    picked once is picked in every later run while it exists, so its first run
    is all that need be kept.
    """
    old = kept.load()
    old = spark.createDataFrame([], "seed long, run_no int, crop_key string") if old is None else old
    people = Scratch(spark, "population").save(population(crops), "keys")
    run_no = (old.agg(F.max("run_no")).head()[0] or 0) + 1
    drawn = draws(spark, people.select("crop_key", "added"), old.select("seed", F.lit(run_no).alias("run_no"), "crop_key"), [Sample(s, run_no, f, upto) for s, f in frac.items()])
    return kept.save(old.unionByName(drawn.filter("not kept").select(*old.columns)))


def in_two_runs(spark: SparkSession, selections: DataFrame, crops: DataFrame, path: str | None = None) -> DataFrame:
    """(seed, run_no, crop_key): the ledger after a run as of the first recorded time of a seed and one over all keys.

    The ledger lies in the folder ``path``, by default one of this run's own.
    """
    runs = recorded_runs(selections)
    frac = {x.seed: x.frac for x in runs}
    kept = Kept(spark, path or Scratch(spark, "ledger").path("kept"))
    next_run(spark, crops, kept, frac, min((x.upto for x in runs if x.upto is not None), default=None))
    return next_run(spark, crops, kept, frac)


def current_sample(spark: SparkSession, selections: DataFrame, crops: DataFrame) -> DataFrame:
    """(seed, crop_key, kept): today's sample of every recorded seed, after all recorded runs.

    The fraction of a seed is that of its latest run.  Empty tables give no row.
    """
    scratch = Scratch(spark, "population")
    people = scratch.save(population(crops), "keys")
    fracs = {r["seed"]: r["frac"] for r in selections.filter("seed is not null and frac is not null").groupBy("seed").agg(F.max_by("frac", F.struct("run_no", "frac")).alias("frac")).collect()}  # one row per seed
    seen = ledger(selections).select("seed", F.col("crop_key").alias("name")).distinct().join(people.select("name", "crop_key"), "name")
    return draw(spark, people.select("crop_key"), seen.select("seed", "crop_key"), fracs)
