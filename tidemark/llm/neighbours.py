"""The most similar vectors of every vector, from robust-pruned graphs over shards.

Unit vectors are sorted into cells around a bounded set of centres; cells grow
with the data to LARGEST vectors, beyond which they are split by hash.  Every
shard holds one directed graph (vamana.py).  A query searches by beam its own
shard, where it already lies, and the shards of its other nearest cells (as many
as a measurement on the sample asks for) or of all cells; its best answers are
merged.  Where only close neighbours count, the queries travel in one byte a
dimension and the answers' similarities are computed again from the vectors.
Exact copies of a vector stand in the index once and answer for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.vamana import ALPHA, Graph
from tidemark.operators.joins import lookup_join
from tidemark.session import Scratch

K = 5
SHARD = 1024  # vectors of a cell on average, while centres are below MOST_CENTRES, where a query searches its nearest cells
WIDE_SHARD = 4096  # where it searches all
LARGEST = 16384  # vectors of a shard; larger cells are split by hash
MOST_CENTRES = 4096  # of a group
SAMPLE = 32768  # most vectors of a group that the centres are fitted on, 16 a centre
QUERIES = 65536  # of one shard that one task answers
COVERED = 0.99  # share of neighbours at the least similarity whose cell must be among those searched from one side or the other
COVERED_ALL = 0.95  # the same where every neighbour counts
CLOSE = 0.5  # least similarity from which queries travel in one byte a dimension
CLOSE_DEGREE = 20  # of the graphs there, built in one pass: close neighbours are found with less
SLACK = 0.02  # of the similarity of such a query
BEAM = 16
WIDE_BEAM = 96
ALONE = ("murk-so400",)  # backbones whose readout is patch_mean alone
UNIT = "id long, grp string, vec binary"


def unit_vectors(readouts: DataFrame, alone: tuple[str, ...] = ALONE) -> DataFrame:
    """(id, grp, vec): each usable readout once, its joined unit vector as float32 bytes.

    The vector is cls and patch_mean, each scaled to length one, joined and
    scaled again; for the backbones of ``alone`` patch_mean.  Rows that miss a
    needed vector, or have one of length zero or with NaN or infinity, and rows
    without id take no part.  grp is backbone, layer and dimension.
    """

    def scale(v: object) -> np.ndarray | None:
        if v is None:
            return None
        a = np.array([np.nan if x is None else x for x in v], np.float64)  # type: ignore[union-attr]
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt(a @ a) if len(a) and np.isfinite(a).all() else 0.0
        return a / length if 0 < length < np.inf else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, backbone, layer, cls, patch in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                parts = [scale(patch)] if backbone in alone else [scale(cls), scale(patch)]
                if i is not None and all(p is not None for p in parts):
                    v = (np.concatenate(parts) / np.sqrt(len(parts))).astype(np.float32)
                    rows.append((i, f"{backbone}|{layer}|{len(v)}", v.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["id", "grp", "vec"])

    rows = readouts.select("readout_id", "backbone", "layer", "cls", "patch_mean").dropDuplicates(["readout_id"])
    return rows.mapInArrow(make, UNIT)


def _means(sample: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        owner = np.argmax(sample @ centres.T, 1)
        total = np.zeros_like(centres)
        np.add.at(total, owner, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, total / np.maximum(length, 1e-6), centres)
    return centres.astype(np.float32)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """At most k unit centres by spherical k-means, beyond 256 in two levels; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    if k <= 256 or len(sample) <= k:
        return _means(sample, k, rounds, rng)
    upper = _means(sample, int(np.ceil(np.sqrt(k))), rounds, rng)
    owner = np.argmax(sample @ upper.T, 1)
    return np.concatenate([_means(own, max(1, k * len(own) // len(sample)), rounds, rng) for c in range(len(upper)) if len(own := sample[owner == c])])


def needed_probes(sample: np.ndarray, centres: np.ndarray, least: float, k: int, seed: int = 0) -> int:
    """Cells to search from either side of a pair, so that the share COVERED of pairs is met.

    The pairs are vectors of the sample, and points made at the least similarity
    from them in random directions, which are the hardest; where less than CLOSE
    counts, the k nearest within the sample, for the share COVERED_ALL.
    """
    x = sample[:2048]
    if len(centres) == 1 or len(sample) < 2:
        return 1
    if least >= CLOSE:
        z = np.random.default_rng(seed).normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        a, b, share = x, least * x + np.sqrt(1 - least * least) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), COVERED
    else:
        near = np.argsort(-(x @ sample.T), 1)[:, 1 : k + 1]
        a, b, share = np.repeat(x, near.shape[1], 0), sample[near.ravel()], COVERED_ALL
    sa, sb = a @ centres.T, b @ centres.T
    rank = lambda s, t: (s > np.take_along_axis(s, t.argmax(1)[:, None], 1)).sum(1)
    return int(np.quantile(np.minimum(rank(sa, sb), rank(sb, sa)), share, method="higher")) + 1


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def _short(x: np.ndarray) -> np.ndarray:
    """Unit vectors in one byte a dimension."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(1, keepdims=True), 1e-12))).astype(np.int8)


def _long(values: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(values), np.int8).reshape(len(values), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def similar(spark: SparkSession, units: DataFrame, k: int = K, queries: DataFrame | None = None, probes: int | str | None = "measured", least: float = -2.0, beam: int = BEAM, shard: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """(id, neighbour, sim): the k most similar other vectors of the same group for each query id.

    units as from unit_vectors, queries a DataFrame of ids or None for all.
    probes is the number of cells searched, ``measured`` on the sample, or None
    for every cell.  Only neighbours with sim of at least ``least`` are given;
    with all vectors as queries an answer found from either side counts for
    both.  Ties go to the smaller id.  An empty table, and a vector alone in its
    group, give no row.
    """
    scratch = Scratch(spark, "similar")
    # equal vectors meet by 128 bits of hash, so only ids are shuffled for them
    same = ["grp", "h1", "h2"]
    hashed = units.select("id", "grp", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.reverse(F.hex("vec"))).alias("h2"))
    many = scratch.save(hashed.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "copied")
    copies = scratch.save(lookup_join(hashed, many, same).select("id", "rep"), "copies-of")
    classes = scratch.save(lookup_join(units, copies.filter("id <> rep").select("id"), ["id"], "left_anti").withColumnRenamed("id", "rep"), "classes")
    members = scratch.save(classes.select(F.col("rep").alias("id"), "rep").unionByName(copies.filter("id <> rep")), "members")
    sizes = {r["grp"]: r["n"] for r in classes.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # one row per backbone and layer
    cells_of = {g: int(max(1, min(MOST_CENTRES, -(-n // shard)))) for g, n in sizes.items()}

    # centres: fitted on a bounded hash sample of each group
    chance = F.lit(0.0)
    for g, n in sizes.items():
        chance = F.when(F.col("grp") == g, F.lit(min(1.0, min(SAMPLE, max(2048, 16 * cells_of[g])) / n))).otherwise(chance)
    picked = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < chance * (1 << 30)).select("grp", "rep", "vec").collect()  # about SAMPLE rows per group at most
    centres, reach = {}, {}
    for g in sizes:
        own = sorted((r["rep"], r["vec"]) for r in picked if r["grp"] == g)
        if own:
            sample = _matrix([v for _, v in own])
            centres[g] = fit_centres(sample, cells_of[g])
            reach[g] = needed_probes(sample, centres[g], least, k) if probes == "measured" else probes
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CENTRES vectors per group
    short = least >= CLOSE

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, vec = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            cells: list = [[0]] * len(grp)
            for g in set(grp):
                at = [i for i, x in enumerate(grp) if x == g]
                c = shared.value.get(g)
                if c is None:
                    continue
                scores = _matrix([vec[i] for i in at]) @ c.T
                order = np.argsort(-scores, 1, kind="stable")
                for i, o in zip(at, order, strict=True):
                    cells[i] = (o if reach[g] is None else o[: reach[g]]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cells, pa.list_(pa.int32()))], names=["grp", "rep", "vec", "cells"])

    placed = scratch.save(classes.select("grp", "rep", "vec").mapInArrow(locate, "grp string, rep long, vec binary, cells array<int>"), "placed")
    asking = placed if queries is None else placed.join(members.join(queries, "id", "left_semi").select("rep").distinct(), "rep", "left_semi")
    index = placed.select("grp", F.element_at("cells", 1).alias("cell"), "rep", "vec")
    asked = asking.select("grp", F.posexplode("cells").alias("place", "cell"), "rep", "vec")
    # a row per cell, at most MOST_CENTRES per group: into how many shards and query portions it goes
    n_index = index.groupBy("grp", "cell").agg(F.ceil(F.count("*") / F.lit(largest)).cast("int").alias("shards"))
    n_asked = asked.groupBy("grp", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("portions"))
    plan = F.broadcast(scratch.save(n_index.join(n_asked, ["grp", "cell"]), "plan"))
    own_part = lambda c: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(c)).cast("int")
    parts = ["grp", "cell", "shard", "portion", "role", "rep", "vec"]
    held = index.join(plan, ["grp", "cell"]).withColumn("shard", own_part("shards")).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).withColumn("role", F.lit(0)).select(*parts)
    sent = asked.join(plan, ["grp", "cell"]).withColumn("portion", own_part("portions")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("role", F.lit(1))
    if queries is None:  # a vector asks its own shard where it lies
        sent = sent.filter((F.col("place") > 0) | (F.col("shard") != own_part("shards")))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [_short(_matrix([v]))[0].tobytes() for v in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(small, pa.binary())], names=parts)

    sent = sent.select(*parts)
    if short:
        sent = sent.mapInArrow(shorten, sent.schema)
    both = held.unionByName(sent)
    own_queries = queries is None
    floor = least - SLACK if short else least

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        held, ask = frame[frame["role"] == 0], frame[frame["role"] == 1]
        if not len(held):
            return pd.DataFrame({"rep": [], "near": [], "sim": []})
        ids, x = held["rep"].to_numpy(), _matrix(list(held["vec"]))
        own, q = ask["rep"].to_numpy(), (_long if short else _matrix)(list(ask["vec"])) if len(ask) else np.empty((0, x.shape[1]), np.float32)
        if own_queries and frame["portion"].iat[0] == 0:
            own, q = np.concatenate([ids, own]), np.concatenate([x, q])
        graph = Graph(x, CLOSE_DEGREE, passes=(ALPHA,)) if short else Graph(x)
        found, sims = graph.search(q, min(beam, max(len(ids), 1)))
        found, sims = found[:, : 2 * k + 1 if short else k + 1], sims[:, : 2 * k + 1 if short else k + 1]
        row, col = np.nonzero((found >= 0) & (sims >= floor - 1e-4))
        near = ids[found[row, col]]
        exact = np.einsum("ij,ij->i", q[row].astype(np.float64), x[found[row, col]].astype(np.float64))
        good = (near != own[row]) & (exact >= floor)
        return pd.DataFrame({"rep": own[row][good], "near": near[good], "sim": np.round(exact[good], 9)})

    hits = both.groupBy("grp", "cell", "shard", "portion").applyInPandas(answer, "rep long, near long, sim double")
    hits = scratch.save(hits, "hits")
    if short:
        hits = scratch.save(_exact(hits, placed).filter(F.col("sim") >= least), "exact")
        hits = hits.unionByName(hits.select(F.col("near").alias("rep"), F.col("rep").alias("near"), "sim"))
    order = (F.desc("sim"), "near")
    if queries is None and not short:
        back = hits.select(F.col("near").alias("rep"), F.col("rep").alias("near"), "sim")
        # a hub that many name is cut down in salted parts first
        part = Window.partitionBy("rep", F.pmod(F.xxhash64("near"), F.lit(32))).orderBy(*order)
        back = back.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= k + 1).drop("rn")
        hits = hits.unionByName(back)
    hits = hits.dropDuplicates(["rep", "near"])
    top = hits.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).filter(F.col("rn") <= k).drop("rn")

    # copies: the smallest ids of each class stand for it; a class answers its own members first
    low = members.join(many.select("rep"), "rep", "left_semi")
    part = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    low = low.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= k + 1).drop("rn")
    low = low.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("rn") <= k + 1).drop("rn")
    low = scratch.save(low, "copies")
    wide_of = low.select(F.col("rep").alias("near"), F.col("id").alias("neighbour"))
    wide = top.join(wide_of, "near", "left").select("rep", F.coalesce("neighbour", "near").alias("neighbour"), "sim")
    wide = wide.unionByName(low.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("sim")))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "neighbour"))), 1, k + 1)  # at most (k + 1) squared
    lists = wide.groupBy("rep").agg(best.alias("best"))
    people = members if queries is None else members.join(queries, "id", "left_semi")
    own = F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("id")), 1, k)
    return people.join(lists, "rep").select("id", F.explode(own).alias("b")).select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.d")).alias("sim"))


def _exact(hits: DataFrame, placed: DataFrame) -> DataFrame:
    """The distinct pairs of hits, smaller rep first, with their similarity from the vectors themselves."""
    pairs = hits.select(F.least("rep", "near").alias("rep"), F.greatest("rep", "near").alias("near")).distinct()
    ids = pairs.select("rep").unionByName(pairs.select(F.col("near").alias("rep"))).distinct()
    vectors = Scratch(hits.sparkSession, "vectors").save(lookup_join(placed.select("rep", "vec"), ids, ["rep"], "left_semi"), "met")
    both = pairs.join(vectors.withColumnRenamed("vec", "a"), "rep").join(vectors.select(F.col("rep").alias("near"), F.col("vec").alias("b")), "near")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [float(np.frombuffer(a, np.float32).astype(np.float64) @ np.frombuffer(b, np.float32).astype(np.float64)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(sims, 9), pa.float64())], names=["rep", "near", "sim"])

    return both.select("rep", "near", "a", "b").mapInArrow(product, "rep long, near long, sim double")


MEASURED = 2048  # queries that the recall is measured on


def recall(spark: SparkSession, units: DataFrame, found: DataFrame, queries: DataFrame, k: int = K, least: float = -2.0, most: int = MEASURED) -> DataFrame:
    """(grp, asked, recall): share of the true k nearest of each query (with sim of at least ``least``) that ``found`` has, by group.

    The truth is brute force over all units, block by block, for the ``most``
    queries of lowest id hash (the stated bound of the measurement).  A neighbour
    counts as found if it is as similar as the k-th true one.
    """
    scratch = Scratch(spark, "recall")
    asked = scratch.save(units.join(queries.distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most), "asked")
    held: dict[str, tuple] = {}
    for r in asked.collect():  # at most ``most`` vectors
        held.setdefault(r["grp"], ([], []))
        held[r["grp"]][0].append(r["id"])
        held[r["grp"]][1].append(r["vec"])
    shared = spark.sparkContext.broadcast({g: (np.array(i), _matrix(v)) for g, (i, v) in held.items()})

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, own in frame.groupby("grp"):
                if g not in shared.value:
                    continue
                ids, q = shared.value[g]
                near, x = own["id"].to_numpy(), _matrix(list(own["vec"]))
                sims = q.astype(np.float64) @ x.astype(np.float64).T
                sims[ids[:, None] == near[None, :]] = -np.inf
                top = np.argsort(-sims, 1)[:, :k]
                row = np.repeat(np.arange(len(ids)), top.shape[1])
                out = pd.DataFrame({"grp": g, "id": ids[row], "sim": sims[row, top.ravel()]})
                yield out[out["sim"] >= least]

    best = units.select("grp", "id", "vec").mapInPandas(block, "grp string, id long, sim double")
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim")))).filter(F.col("rn") <= k)
    truth = best.groupBy("grp", "id").agg(F.count("*").alias("true"), F.min("sim").alias("last"))
    met = found.select("id", F.col("sim").alias("s")).join(truth, "id").filter(F.col("s") >= F.col("last") - 1e-6).groupBy("id").agg(F.count("*").alias("met"))
    both = truth.join(met, "id", "left").withColumn("met", F.least(F.coalesce("met", F.lit(0)), "true"))
    return both.groupBy("grp").agg(F.count("*").alias("asked"), F.round(F.sum("met") / F.sum("true"), 4).alias("recall"))


def close_pairs(spark: SparkSession, readouts: DataFrame, k: int = K, least: float = 0.9, alone: tuple[str, ...] = ALONE) -> DataFrame:
    """(readout_id_a, readout_id_b), a < b: readouts of one backbone and layer, each among the other's k most similar, with sim of at least ``least``."""
    near = Scratch(spark, "pairs").save(similar(spark, Scratch(spark, "units").save(unit_vectors(readouts, alone), "units"), k, least=least), "near")
    pairs = near.select(F.least("id", "neighbour").alias("readout_id_a"), F.greatest("id", "neighbour").alias("readout_id_b"))
    return pairs.groupBy("readout_id_a", "readout_id_b").agg(F.count("*").alias("sides")).filter("sides = 2").drop("sides")
