"""Resolving superseded identifiers and concept names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch


# fixed values: statuses that leave the choice of a replacement to a person
DOUBTFUL = ("alternate representation", "nomen dubium", "taxon inquirendum", "uncertain", "interim unpublished")


def known_records(records: DataFrame) -> DataFrame:
    """id, status (lower case, empty for none), choice: each record once, the valid id where it names another one.

    Rows without an id are left out; of repeats the smallest (valid, status)
    counts; a valid id of 0 is none.
    """
    status = F.lower(F.trim(F.coalesce(F.col("r.status"), F.lit(""))))
    one = records.filter("id is not null").groupBy("id").agg(F.min(F.struct("valid", "status")).alias("r"))
    return one.select("id", status.alias("status"), F.when((F.col("r.valid") != 0) & (F.col("r.valid") != F.col("id")), F.col("r.valid")).alias("choice"))


def resolve_accepted(records: DataFrame, depth: int = 5) -> DataFrame:
    """id, final, last, hops, origin_status, outcome, note: the id that each record of (id, valid, status) stands for.

    accepted: its own status is accepted.  remapped: the chain of valid ids comes
    to an accepted record.  kept: the chain comes to a record that offers no
    other; the original id stays (last is that record).  review, without final: the original status is
    DOUBTFUL and a replacement is offered, a record is missing, the chain is
    circular, or not at its end within depth records.  At most depth - 1 joins;
    settled rows keep their own key, so that they spread evenly.
    """
    known = known_records(records)
    state = known.select("id", F.col("id").alias("at"), F.col("status").alias("origin_status"), "status", "choice", F.lit(True).alias("there"), F.array("id").alias("seen"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("note"))
    nowhere = F.col("outcome").isNull()

    def judged(df: DataFrame, first: bool) -> DataFrame:
        doubt = F.lit(first) & F.col("status").isin(*DOUBTFUL) & F.col("choice").isNotNull()
        cases = (
            (~F.col("there"), "review", "no record"), (doubt, "review", "doubtful status with a replacement"), (F.col("status") == "accepted", None, ""),
            (F.col("choice").isNull(), "kept", "no replacement offered"), (F.array_contains("seen", F.col("choice")), "review", "circular"),
        )
        outcome, note = F.lit(None).cast("string"), F.lit(None).cast("string")
        for case, what, why in reversed(cases):
            settled = F.when(F.col("at") == F.col("id"), "accepted").otherwise("remapped") if what is None else F.lit(what)
            outcome, note = F.when(case, settled).otherwise(outcome), F.when(case, F.lit(why)).otherwise(note)
        return df.withColumn("note", F.when(nowhere, note).otherwise(F.col("note"))).withColumn("outcome", F.when(nowhere, outcome).otherwise(F.col("outcome")))

    state = judged(state, True)
    for _ in range(depth - 1):
        there = known.select(F.col("id").alias("_key"), F.lit(True).alias("_open"), F.col("status").alias("_status"), F.col("choice").alias("_choice"))
        moved = state.withColumn("_open", nowhere).withColumn("_key", F.when(nowhere, F.col("choice")).otherwise(F.col("id"))).join(there, ["_key", "_open"], "left")
        go = F.col("_open")
        state = judged(
            moved.select(
                "id", F.when(go, F.col("_key")).otherwise(F.col("at")).alias("at"), "origin_status", F.when(go, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(go, F.col("_choice")).otherwise(F.col("choice")).alias("choice"),
                (~go | F.col("_status").isNotNull()).alias("there"), F.when(go, F.concat("seen", F.array("_key"))).otherwise(F.col("seen")).alias("seen"), (F.col("hops") + go.cast("int")).alias("hops"), "outcome", "note",
            ),
            False,
        )
    final = F.when(F.col("outcome") == "kept", F.col("id")).when(F.col("outcome").isin("accepted", "remapped"), F.col("at"))
    return state.select("id", final.alias("final"), F.col("at").alias("last"), "hops", "origin_status", F.coalesce("outcome", F.lit("review")).alias("outcome"), F.coalesce("note", F.lit("too long a chain")).alias("note"))


def resolve_map(taxa: DataFrame, records: DataFrame, depth: int = 5) -> DataFrame:
    """The rows of taxa (key, aphia_id) with resolved, outcome, origin_status and note.

    An id that is null or 0 stays as it is, with outcome none; an id without a
    record goes to review.  ``changes``, ``for_review`` and ``merges`` read the result.
    """
    found = resolve_accepted(records, depth).select(F.col("id").alias("aphia_id"), "final", "outcome", "origin_status", "note")
    asked = F.coalesce(F.col("aphia_id"), F.lit(0)) != 0
    both = taxa.select("key", "aphia_id").join(found, "aphia_id", "left")
    return both.select(
        "key", "aphia_id", F.when(asked, F.col("final")).otherwise(F.col("aphia_id")).alias("resolved"), F.when(asked, F.coalesce("outcome", F.lit("review"))).otherwise("none").alias("outcome"), F.when(asked, F.col("origin_status")).alias("origin_status"),
        F.when(asked, F.coalesce("note", F.lit("no record"))).alias("note"),
    )


def changes(mapped: DataFrame) -> DataFrame:
    """key, aphia_id, resolved, status of the rows of a resolved map that were remapped or kept for want of a replacement."""
    kept = F.col("outcome") == "kept"
    return mapped.filter(F.col("outcome").isin("remapped", "kept")).select("key", "aphia_id", "resolved", F.when(kept, F.concat("origin_status", F.lit(" (kept)"))).otherwise(F.col("origin_status")).alias("status"))


def for_review(mapped: DataFrame) -> DataFrame:
    """key, aphia_id, origin_status, note of the rows that a person must decide."""
    return mapped.filter("outcome = 'review'").select("key", "aphia_id", "origin_status", "note")


def merges(resolved: DataFrame, column: str = "final") -> DataFrame:
    """column, n: identifiers that several rows now share."""
    return resolved.filter(F.coalesce(F.col(column), F.lit(0)) != 0).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def audit_chains(present: DataFrame, records: DataFrame, depth: int = 5) -> DataFrame:
    """id, final, hops, action for each id present: ok, merge (where its chain ends is present too), rename, or review.

    Only an unaccepted record whose chain ends at another one may move, also
    where that one is not accepted; a doubtful status or an unsettled chain never does.
    """
    ids = present.filter("id is not null").select("id").distinct()
    walked = ids.join(resolve_accepted(records, depth).drop("final").withColumnRenamed("last", "final"), "id", "left")
    target = walked.join(ids.select(F.col("id").alias("final"), F.lit(True).alias("held")), "final", "left")
    settled = F.coalesce(F.col("outcome") != "review", F.lit(False))
    moves = settled & (F.col("origin_status") == "unaccepted") & (F.col("final") != F.col("id"))
    action = F.when(F.col("outcome") == "accepted", "ok").when(moves & F.coalesce("held", F.lit(False)), "merge").when(moves, "rename").otherwise("review")
    return target.select("id", F.when(settled, F.col("final")).alias("final"), F.coalesce("hops", F.lit(0)).alias("hops"), action.alias("action"))


def by_name(names: DataFrame, records: DataFrame, depth: int = 5) -> DataFrame:
    """name, final, valid_name, taxon_rank of the names that exactly one record bears, accepted ones first.

    records has id, valid, status, name, valid_name, taxon_rank.  The record is
    resolved; an ambiguous name, or one whose record goes to review, gives nulls.
    """
    wanted = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    exact = records.filter("id is not null").select("id", F.trim("name").alias("name"), (F.coalesce("status", F.lit("")) == "accepted").alias("good")).distinct()
    count = lambda c: F.count(F.when(c, 1))
    per = exact.groupBy("name").agg(count(F.col("good")).alias("good"), F.count("*").alias("all"), F.min(F.when(F.col("good"), F.col("id"))).alias("a"), F.min("id").alias("b"))
    one = per.select("name", F.when(F.col("good") == 1, F.col("a")).when((F.col("good") == 0) & (F.col("all") == 1), F.col("b")).alias("id"))
    settled = resolve_accepted(records, depth).select("id", "final")
    shown = records.groupBy(F.col("id").alias("final")).agg(F.min(F.struct(F.coalesce("valid_name", "name").alias("valid_name"), "taxon_rank")).alias("r")).select("final", "r.*")
    return wanted.join(one, "name", "left").join(settled, "id", "left").join(shown, "final", "left").select("name", "final", "valid_name", "taxon_rank")


def revive(rows: DataFrame, ident: str, kept: str, weight: str, least: int) -> DataFrame:
    """rows with kept set where the weights of all rows of one id reach the bar together."""
    total = rows.groupBy(ident).agg(F.sum(weight).alias("_t"))
    return rows.join(total, ident).withColumn(kept, F.col(kept) | (F.col("_t") >= least)).drop("_t")


def unique_match(names: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """names with the record id where exactly one record matches."""
    one = records.groupBy(*on).agg(F.count("*").alias("_c"), F.min("id").alias("match")).filter("_c = 1").drop("_c")
    return names.join(one, on, "left")


def greedy_cover(counts: DataFrame, need: int, picks: int) -> list[tuple[str, int]]:
    """Groups in the order picked, with their gain: each adds most of what taxa still lack.

    counts has group, taxon, units.  gain = sum over taxa of min(units, what is
    lacking); ties go to the smaller group.  Each pick is one distributed
    aggregate; only the pick itself comes to the driver.
    """
    spark = counts.sparkSession
    have = counts.select("taxon").distinct().withColumn("have", F.lit(0).cast("long"))
    out: list[tuple[str, int]] = []
    taken = spark.createDataFrame([], counts.select("group").schema)
    for _ in range(picks):
        lack = F.greatest(F.lit(0), F.least(F.col("units"), F.lit(need) - F.col("have")))
        gains = counts.join(taken, "group", "left_anti").join(have, "taxon").groupBy("group").agg(F.sum(lack).alias("gain")).filter("gain > 0")
        best = gains.orderBy(F.desc("gain"), "group").head()
        if best is None:
            break
        out.append((best["group"], int(best["gain"])))
        taken = spark.createDataFrame([(g,) for g, _ in out], counts.select("group").schema)
        have = counts.select("taxon").distinct().join(counts.join(F.broadcast(taken), "group").groupBy("taxon").agg(F.sum("units").alias("have")), "taxon", "left").select("taxon", F.coalesce("have", F.lit(0)).alias("have"))
    return out


def staged_cover(counts: DataFrame, stages: list[str], picks: dict[str, int], need: int, protected: list[tuple[int, int]], bar: int | None = None) -> list[tuple[str, str, float, int]]:
    """(stage, group, gain, taxa that reach ``need``) in the order picked.

    counts has stage, group, taxon, units.  Stage by stage the group is picked
    that adds most of what the taxa lack: sum of max(0, min(units, need - have)),
    in the first stage by its own units, later by all picked so far; ties go to
    the smaller group.  A group that would leave a taxon of the rest under a
    protected gate (units, groups) which it passes at the start is not picked.
    With ``bar`` the picks end where so many taxa reach need: as a longer run
    begins with a shorter one, that is the smallest set.  Every pick is one
    distributed aggregate over (group, taxon) counts; only the pick comes to
    the driver.
    """
    spark = counts.sparkSession
    held = Scratch(spark, "cover").save(counts.filter("units > 0"), "counts")
    taken = spark.createDataFrame([], "stage string, group string")
    out: list[tuple[str, str, float, int]] = []
    keyed = held.withColumn("group", F.col("group").cast("string"))
    start = keyed.groupBy("taxon").agg(F.sum("units").alias("u0"), F.count_distinct("stage", "group").alias("g0"))
    for number, stage in enumerate(stages):
        while sum(1 for s, *_ in out if s == stage) < picks[stage]:
            chosen = keyed.join(F.broadcast(taken), ["stage", "group"], "left_semi")  # as many rows as picks
            rest = keyed.join(F.broadcast(taken), ["stage", "group"], "left_anti")
            counted = chosen if number else chosen.filter(F.col("stage") == stage)
            have = counted.groupBy("taxon").agg(F.sum("units").alias("have"))
            left = rest.groupBy("taxon").agg(F.sum("units").alias("u"), F.count_distinct("stage", "group").alias("g")).join(start, "taxon")
            avail = rest.filter(F.col("stage") == stage).join(left, "taxon").join(have, "taxon", "left")
            breaks = F.lit(False)
            for units, groups in protected:
                breaks |= (F.col("u0") >= units) & (F.col("g0") >= groups) & ((F.col("u") - F.col("units") < units) | (F.col("g") - 1 < groups))
            lack = F.greatest(F.lit(0), F.least(F.col("units"), F.lit(need) - F.coalesce("have", F.lit(0))))
            gains = avail.groupBy("group").agg(F.sum(lack).cast("double").alias("gain"), F.bool_or(breaks).alias("breaks")).filter("not breaks and gain > 0")
            best = gains.orderBy(F.desc("gain"), "group").head()
            if best is None:
                break
            taken = spark.createDataFrame([(s, g) for s, g, *_ in out] + [(stage, best["group"])], "stage string, group string")
            now = keyed.join(F.broadcast(taken), ["stage", "group"], "left_semi").groupBy("taxon").agg(F.sum("units").alias("h")).filter(F.col("h") >= need).count()
            out.append((stage, best["group"], float(best["gain"]), now))
            if bar is not None and now >= bar:
                return out
    return out
