"""Splits that keep related records together.

A component table is kept from run to run in a named folder: entity, component,
split, status, weight.  A run reads only its new rows: new links merge components
by hooking and pointer jumping; a component that already has a split keeps it,
new ones fill what each split lacks, and a merge of components with different
splits is quarantined instead of moving records.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import place_key, source_name
from tidemark.operators.graph import components
from tidemark.operators.joins import lookup_join
from tidemark.session import Kept, Scratch

TARGETS = {"train": 0.7, "dev": 0.15, "lock": 0.15}
HEAVY = 0.005  # a component above this share of all weight is placed on its own, largest first
BUCKETS = 4096
STATE = "entity string, component string, split string, status string"


def split_name(c: str):
    """train, dev or lock whatever the case and outer space; anything else is null (unassigned)."""
    k = F.lower(F.regexp_replace(F.col(c), "^\\s+|\\s+$", ""))
    return F.when(k.isin(*TARGETS), k)


def merge_state(spark: SparkSession, state: DataFrame | None, entities: DataFrame, links: DataFrame) -> DataFrame:
    """(entity, component, split, status) after new entities and links.

    state is the kept table or None; entities has entity, claimed (array of
    splits its records already carry, may be empty).  status is kept, new or
    quarantined; a quarantined component has no split.  A merged component is
    named after its smallest entity.
    """
    scratch = Scratch(spark, "splits")
    old = state if state is not None else spark.createDataFrame([], STATE)
    # an entity links to its kept component's first entity, so old merges persist without their links
    anchors = old.select(F.col("entity").alias("a"), F.col("component").alias("b"))
    roots = components(anchors.unionByName(links.select("a", "b")), "splits-components").select(F.col("v").alias("entity"), F.col("root").alias("component"))
    held = old.select("entity", F.when(F.col("split").isNotNull(), F.array("split")).otherwise(F.array().cast("array<string>")).alias("claimed"), (F.col("status") == "quarantined").alias("stopped"))
    claims = entities.select("entity", "claimed", F.lit(False).alias("stopped")).unionByName(held)
    every = claims.join(roots, "entity", "left").withColumn("component", F.coalesce("component", "entity"))
    flat = every.select("component", "stopped", F.explode_outer("claimed").alias("s"))
    merged = flat.groupBy("component").agg(F.collect_set("s").alias("splits"), F.bool_or("stopped").alias("stopped"))  # at most one element per split name
    status = F.when(F.col("stopped") | (F.size("splits") > 1), "quarantined").when(F.size("splits") == 1, "kept").otherwise("new")
    judged = merged.select("component", status.alias("status"), F.when(~F.col("stopped") & (F.size("splits") == 1), F.element_at("splits", 1)).alias("split"))
    return scratch.save(every.select("entity", "component").distinct().join(judged, "component").select("entity", "component", "split", "status"), "state")


def fill_new(spark: SparkSession, state: DataFrame, weights: DataFrame, targets: dict[str, float] = TARGETS, seed: int = 0) -> DataFrame:
    """Gives new components a split: (entity, component, split, status).

    weights has entity, weight.  Components above HEAVY of all weight (at most
    1 / HEAVY of them) are placed largest first where most is lacking; the rest
    take their place in a hash order cut at what each split then lacks, found
    from the exact weight of BUCKETS hash ranges.  Quarantined weight counts for
    no split.
    """
    scratch = Scratch(spark, "fill")
    per = state.join(weights, "entity", "left").groupBy("component").agg(F.first("split").alias("split"), F.first("status").alias("status"), F.sum(F.coalesce("weight", F.lit(0))).alias("weight"))
    per = scratch.save(per.withColumn("bucket", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(BUCKETS)).cast("int")), "weights")
    have = {r["split"]: float(r["w"]) for r in per.filter("status = 'kept'").groupBy("split").agg(F.sum("weight").alias("w")).collect()}  # one row per split
    fresh = per.filter("status = 'new'")
    total = sum(have.values()) + float(fresh.agg(F.sum("weight")).head()[0] or 0)
    lacking = {s: share * total - have.get(s, 0.0) for s, share in targets.items()}
    heavy = fresh.filter(F.col("weight") > HEAVY * total).orderBy(F.desc("weight"), "component").select("component", "weight").collect()  # at most 1 / HEAVY rows
    placed = []
    for r in heavy:
        s = max(lacking, key=lambda x: lacking[x])
        lacking[s] -= float(r["weight"])
        placed.append((r["component"], s))
    placed_df = spark.createDataFrame(pd.DataFrame(placed, columns=["component", "given"]), "component string, given string") if placed else spark.createDataFrame([], "component string, given string")
    light = fresh.join(F.broadcast(placed_df), "component", "left_anti")
    # hash ranges: BUCKETS rows, then the order within one range only
    ranges = light.groupBy("bucket").agg(F.sum("weight").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("weight").over(Window.partitionBy("bucket").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    positive = {s: max(0.0, x) for s, x in lacking.items()}
    room = sum(positive.values()) or 1.0
    rest = max(0.0, total - sum(have.values()) - sum(float(r["weight"]) for r in heavy)) or 1.0
    middle = (F.col("before") + within + F.col("weight") / 2) / F.lit(rest)
    cut, upto = F.lit(list(targets)[-1]), 0.0
    edges = []
    for s in targets:
        upto += positive[s] / room
        edges.append((s, upto))
    for s, e in reversed(edges[:-1]):
        cut = F.when(middle < F.lit(e), F.lit(s)).otherwise(cut)
    given = light.join(F.broadcast(ranges), "bucket").select("component", cut.alias("given")).unionByName(placed_df)
    return state.join(given, "component", "left").select("entity", "component", F.coalesce("split", "given").alias("split"), "status")


def deployments_table(dev: DataFrame, groups: DataFrame) -> DataFrame:
    """(source, deployment, key, cruise) of both deployment tables, each once."""
    listed = [dev.select(source_name("source").alias("source"), "deployment", F.lit(False).alias("cruise"))]
    listed.append(groups.select(source_name("source").alias("source"), "deployment", (F.lower(F.trim("derived_level")) == "cruise").alias("cruise")))
    named = reduce(DataFrame.unionByName, listed).filter("source is not null and deployment is not null")
    named = named.withColumn("key", place_key("deployment"))
    return named.groupBy("source", "key").agg(F.min("deployment").alias("deployment"), F.bool_or(F.coalesce("cruise", F.lit(False))).alias("cruise"))


def crop_entities(crops: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings, links): each spelled group with its entity and claimed splits; dive to cruise links.

    An entity is ``source|key``.  A cruise takes in every deployment named with
    its name, a joiner (``:``, ``/`` or ``|``) and more.
    """
    found = crops.withColumn("s", source_name("source")).withColumn("split", split_name("split"))
    spelled = found.groupBy("s", "grp").agg(F.count("*").alias("weight"), F.collect_set("split").alias("claimed"))
    spelled = spelled.withColumn("key", place_key("grp")).withColumn("entity", F.when(F.col("s").isNotNull() & F.col("key").isNotNull(), F.concat_ws("|", "s", "key")))
    parts = F.split(F.trim("grp"), "[:/|]")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: place_key(F.concat_ws(":", F.slice(parts, 1, i))))
    dives = spelled.filter(F.col("entity").isNotNull() & (F.size(parts) > 1)).select("s", "entity", F.explode(heads).alias("key")).distinct()
    cruises = listed.filter("cruise").select(F.col("source").alias("s"), "key")
    links = dives.join(cruises, ["s", "key"]).select(F.col("entity").alias("a"), F.concat_ws("|", "s", "key").alias("b")).filter("a <> b")
    return spelled, links


def advance(spark: SparkSession, kept: Kept, crops: DataFrame, listed: DataFrame, targets: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """The kept component table (entity, component, split, status, weight) after the crops of one more run, written as its next version.

    crops are the run's new rows only.  With targets, new components get a split,
    which the next run keeps; without, only the splits that rows carry count.
    """
    scratch = Scratch(spark, "run")
    old = kept.load()
    old = spark.createDataFrame([], STATE + ", weight long") if old is None else old
    spelled, links = crop_entities(crops, listed)
    spelled = scratch.save(spelled, "spelled")
    links = scratch.save(links, "links")
    # a cruise that no crop names belongs to its dives' component all the same
    cruises = links.select(F.col("b").alias("entity"), F.array().cast("array<string>").alias("claimed"), F.lit(0).cast("long").alias("weight"))
    named = spelled.filter("entity is not null").select("entity", "claimed", "weight").unionByName(cruises)
    per = named.groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_set("claimed"))).alias("claimed"), F.sum("weight").alias("weight"))  # at most 8 distinct sets of splits
    per = scratch.save(per, "entities")
    state = merge_state(spark, old.drop("weight"), per.select("entity", "claimed"), links)
    weights = old.select("entity", "weight").unionByName(per.select("entity", "weight")).groupBy("entity").agg(F.sum("weight").alias("weight"))
    if targets:
        state = fill_new(spark, state, weights, targets, seed)
    return kept.save(state.join(weights, "entity", "left").select("entity", "component", "split", "status", F.coalesce("weight", F.lit(0).cast("long")).alias("weight")))


def in_two_runs(spark: SparkSession, crops: DataFrame, listed: DataFrame, path: str | None = None, targets: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """The component table after a run with the crops added in the first half of the time and one with the rest.

    Rows without a time are in the first run.  The table lies in the folder
    ``path``, by default one of this run's own.
    """
    kept = Kept(spark, path or Scratch(spark, "components").path("kept"))
    added = F.unix_micros(F.col("added_at").cast("timestamp"))
    ends = crops.agg(F.min(added).alias("a"), F.max(added).alias("b")).head()
    middle = F.lit(None).cast("long") if ends["a"] is None else F.lit((ends["a"] + ends["b"]) // 2)
    late = F.coalesce(added > middle, F.lit(False))
    advance(spark, kept, crops.filter(~late), listed, targets, seed)
    return advance(spark, kept, crops.filter(late), listed, targets, seed)


def conflicting(spark: SparkSession, crops: DataFrame, dev: DataFrame, groups: DataFrame) -> DataFrame:
    """(source, deployment): the listed deployments whose crops lie in more than one split, a cruise for its dives.

    These are the quarantined components of the kept table after two runs.  Rows without grp or without one of
    the three splits are unassigned and do not count; groups that no deployment
    table lists are not reported; empty tables give no row.
    """
    listed = Scratch(spark, "deployments").save(deployments_table(dev, groups), "listed")
    state = in_two_runs(spark, crops, listed)
    names = listed.select(F.concat_ws("|", "source", "key").alias("entity"), "source", "deployment", "cruise")
    bad = state.filter("status = 'quarantined'").select("entity", "component").distinct()
    cruises = bad.join(names.filter("cruise"), "entity").select("component", "source", "deployment")
    others = bad.join(cruises.select("component").distinct(), "component", "left_anti").join(names, "entity")
    return cruises.select("source", "deployment").unionByName(others.select("source", "deployment")).distinct()


def assign(spark: SparkSession, crops: DataFrame, dev: DataFrame, groups: DataFrame, targets: dict[str, float] = TARGETS, seed: int = 0, path: str | None = None) -> DataFrame:
    """(crop_key, source, component, split, status) for every distinct crop row, after two runs.

    Crops without a group are status ungrouped and have no split; those of
    quarantined components have none until the conflict is resolved.
    """
    listed = Scratch(spark, "deployments").save(deployments_table(dev, groups), "listed")
    full = in_two_runs(spark, crops, listed, path, targets, seed).drop("weight")
    spelled, _ = crop_entities(crops, listed)
    lookup = spelled.join(full, "entity", "left").select(F.coalesce("s", F.lit("")).alias("s"), F.coalesce("grp", F.lit("")).alias("g"), "component", "split", F.coalesce("status", F.lit("ungrouped")).alias("status"))
    lookup = Scratch(spark, "lookup").save(lookup.groupBy("s", "g").agg(F.min("component").alias("component"), F.min("split").alias("split"), F.min("status").alias("status")), "lookup")
    rows = crops.select("crop_key", F.coalesce(source_name("source"), F.lit("")).alias("s"), F.coalesce("grp", F.lit("")).alias("g")).distinct()
    return lookup_join(rows, lookup, ["s", "g"]).select("crop_key", F.nullif("s", F.lit("")).alias("source"), "component", "split", "status")
