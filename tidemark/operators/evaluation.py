"""Recall by level, candidate sets, cells and draws that step down."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import hash_order
from tidemark.operators.ranks import placed
from tidemark.operators.sampling import draw_sides
from tidemark.operators.vectors import macro_recall, predictions

PARENTS = (("species", "genus"), ("genus", "family"), ("family", "ord"))


def recall_by_level(queries: DataFrame, protos: DataFrame, lineage: DataFrame, key: str, label: str, vector: str, parents: Sequence[tuple[str, str]] = PARENTS) -> DataFrame:
    """level, mode, macro_recall, n_classes, n_queries: one classifier over species read at every level.

    lineage has a row per species with the names of its levels.  unconstrained:
    the best of all species.  constrained: the best of the species of the
    query's own parent, for parents with at least two children at that level.
    The answer at a level is the best species' name there; queries without a
    name at the level (or, constrained, without a parent) are left out of it.
    """
    known = lineage.join(protos.select(label).distinct(), label, "left_semi")
    real = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    open_ = predictions(queries, protos, key, label, vector)
    out = []
    for level, parent in parents:
        own = known.select(label, real(level).alias("_own"), real(parent).alias("parent"))
        kids = own.filter("_own is not null and parent is not null").withColumn("_n", F.size(F.collect_set("_own").over(Window.partitionBy("parent")))).filter("_n >= 2")
        held = predictions(queries, protos, key, label, vector, kids.select(label, "parent"))
        for mode, found in (("constrained", held), ("unconstrained", open_)):
            true, said = own.select(label, F.col("_own").alias("true")), own.select(F.col(label).alias("predicted"), F.col("_own").alias("said"))
            rows = found.join(true, label).join(said, "predicted").filter("true is not null").select(F.col("true"), F.col("said").alias("predicted"))
            score = macro_recall(rows, "true")
            out.append(score.select(F.lit(level).alias("level"), F.lit(mode).alias("mode"), "macro_recall", "n_classes", "n_queries"))
    return reduce(DataFrame.unionByName, out)


def candidate_recall(scores: DataFrame, key: str, label: str, candidate: str, score: str, candidates: DataFrame) -> DataFrame:
    """label, recall, n of each candidate's queries, when only the candidates compete.

    Queries of other labels are left out; ties go to the smaller candidate.
    """
    own = F.broadcast(candidates.select(F.col(candidate).alias("_c")).distinct()) if candidates.limit(100_001).count() <= 100_000 else candidates.select(F.col(candidate).alias("_c")).distinct()
    kept = scores.join(own, F.col(candidate) == F.col("_c"), "left_semi").join(own.withColumnRenamed("_c", "_l"), F.col(label) == F.col("_l"), "left_semi")
    best = kept.groupBy(key, label).agg(F.min(F.struct((-F.col(score)).alias("s"), candidate)).alias("b"))
    return best.groupBy(label).agg(F.round(F.avg((F.col(f"b.{candidate}") == F.col(label)).cast("double")), 6).alias("recall"), F.count("*").alias("n"))


def candidates(testable: DataFrame, taxon: str, largest_k: str, k: int, rule: str) -> DataFrame:
    """taxon: those that compete at k.  per_k: testable at k; fixed_kN: testable at N, none where k is above N."""
    if rule == "per_k":
        return testable.filter(F.col(largest_k) >= k).select(taxon)
    need = int(rule.removeprefix("fixed_k"))
    return testable.filter((F.col(largest_k) >= need) & F.lit(k <= need)).select(taxon)


def without(rows: DataFrame, excluded: Mapping[str, object] | None) -> DataFrame:
    """rows without those that have all the excluded values (a sensitivity variant); a null is no such value."""
    if not excluded:
        return rows
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in excluded.items()])
    return rows.filter(~hit)


def cell_name(query: Column, reference: Column, level: Column, arm: Column, matching: Column, variant: Column) -> Column:
    """The name of a scored condition."""
    return F.concat(query, F.lit("<-"), F.concat_ws("|", reference, level, arm, matching, variant))


def cells(pairs: DataFrame, levels: Sequence[str], shared: DataFrame, variants: DataFrame) -> DataFrame:
    """cell, pair, query_source, reference_source, level, arm, matching, variant of the pairs (a, b), both ways.

    The arm shared_children exists for the pairs of ``shared`` above species; a
    variant (a, b, matching, variant) only for whole taxa.
    """
    each = pairs.join(shared.select("a", "b", F.lit(True).alias("_s")), ["a", "b"], "left")
    side = F.array(F.struct(F.col("a").alias("query_source"), F.col("b").alias("reference_source")), F.struct(F.col("b").alias("query_source"), F.col("a").alias("reference_source")))
    arms = F.when(F.coalesce("_s", F.lit(False)) & (F.col("level") != "species"), F.array(F.lit("whole_taxon"), F.lit("shared_children"))).otherwise(F.array(F.lit("whole_taxon")))
    flat = each.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("side", F.explode(side)).withColumn("arm", F.explode(arms))
    flat = flat.withColumn("matching", F.explode(F.array(F.lit("matched"), F.lit("unmatched"))))
    more = flat.filter("arm = 'whole_taxon'").join(variants, ["a", "b", "matching"])
    both = flat.withColumn("variant", F.lit("main")).unionByName(more.select(*flat.columns, "variant"))
    name = cell_name(F.col("side.query_source"), F.col("side.reference_source"), F.col("level"), F.col("arm"), F.col("matching"), F.col("variant"))
    return both.select(name.alias("cell"), F.concat_ws("x", "a", "b").alias("pair"), "side.query_source", "side.reference_source", "level", "arm", "matching", "variant")


def shared_taxa(rows: DataFrame, source: str, taxon: str, query: object, reference: object) -> DataFrame:
    """taxon: those that both sources have (the candidates of a cell)."""
    mine = rows.filter(F.col(taxon).isNotNull())
    return mine.filter(F.col(source) == query).select(taxon).distinct().join(mine.filter(F.col(source) == reference).select(taxon).distinct(), taxon, "left_semi")


def shared_children(rows: DataFrame, source: str, taxon: str, species: str, query: object, reference: object) -> DataFrame:
    """The rows of both sources whose species, within its taxon, the other source has too."""
    named = rows.filter(F.col(species).isNotNull() & F.col(source).isin(query, reference))
    both = named.groupBy(taxon, species).agg(F.count_distinct(source).alias("_n")).filter("_n = 2").select(taxon, species)
    return named.join(both, [taxon, species], "left_semi")


def stepped_draws(queries: DataFrame, references: DataFrame, taxon: str, group: str, key: str, ks: Sequence[int], q: int, groups: int, tries: int = 50, seed: str = "s") -> DataFrame:
    """taxon, k, key, role: per taxon the draw of the largest k of which one of ``tries`` orders fits.

    query: the rows outside the groups drawn for the reference, at least q;
    base: k rows of those groups; cross: k rows of the other source, which has k
    rows in at least ``groups`` groups.  Taxa that no k fits are left out.
    """
    other = references.filter(F.col(taxon).isNotNull()).groupBy(taxon).agg(F.count("*").alias("_n"), F.count_distinct(F.nullif(F.col(group).cast("string"), F.lit(""))).alias("_g")).filter(F.col("_g") >= groups)
    sides = None
    for k in sorted(ks, reverse=True):
        able = queries.join(other.filter(F.col("_n") >= k).select(taxon), taxon, "left_semi")
        if sides is not None:
            able = able.join(sides.select(taxon).distinct(), taxon, "left_anti")
        found = draw_sides(able, taxon, group, k, q, 1, tries, f"{seed}:{k}").select(taxon, group, "role", F.lit(k).alias("k"))
        sides = found if sides is None else sides.unionByName(found)
    members = queries.select(taxon, group, key).join(sides, [taxon, group])
    asked = members.filter("role = 'query'").select(taxon, "k", key, F.lit("query").alias("role"))
    order = [hash_order(F.lit(seed), F.lit("base"), F.col(key)), F.col(key)]
    base = placed(members.filter("role = 'reference'"), [taxon], order).filter(F.col("rn") <= F.col("k")).select(taxon, "k", key, F.lit("base").alias("role"))
    pool = references.select(taxon, key).join(sides.select(taxon, "k").distinct(), taxon)
    order = [hash_order(F.lit(seed), F.lit("cross"), F.col(key)), F.col(key)]
    cross = placed(pool, [taxon], order).filter(F.col("rn") <= F.col("k")).select(taxon, "k", key, F.lit("cross").alias("role"))
    return asked.unionByName(base).unionByName(cross)


def readouts(stores: DataFrame) -> DataFrame:
    """store, token, layer of stores (store, n_layers, has_cls, pooled array): every token on every layer, then the pooled ones."""
    patch = [F.lit("patch_mean"), F.lit("patch_mean_normed")]
    tokens = F.when(F.col("has_cls"), F.array(F.lit("cls"), *patch, F.lit("cls+patch_mean"), F.lit("cls+patch_mean_normed"))).otherwise(F.array(*patch))
    layers = stores.filter("n_layers > 0").select("store", F.explode(F.sequence(F.lit(0), F.col("n_layers") - 1)).alias("layer"), tokens.alias("tokens"))
    return layers.select("store", F.explode("tokens").alias("token"), F.col("layer").cast("string").alias("layer")).unionByName(stores.select("store", F.explode("pooled").alias("token"), F.lit("pooled").alias("layer")))
