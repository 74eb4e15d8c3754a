"""Scoring embeddings: prototypes, recall, leakage and the linear probe."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import lookup_join
from tidemark.session import Scratch


def unit(v: Column) -> Column:
    """The vector (doubles) over the larger of its length and 1e-12."""
    d = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(length, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def readout(parts: Sequence[Column]) -> Column:
    """Each part to unit length, then joined."""
    return F.concat(*[unit(p) for p in parts])


def prototypes(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label, proto: unit sum of the unit vectors of each label.

    Sums per position, so partial aggregation holds one number per label and
    position whatever the number of rows.
    """
    each = rows.select(label, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"))
    packed = each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    return packed.select(label, unit(F.col("s")).alias("proto"))


BLOCK_BYTES = 64 << 20  # most of the prototypes that are sent to every executor, or stand in one block
ROWS = 4096  # queries of one matrix product


def predictions(queries: DataFrame, protos: DataFrame, key: str, label: str, vector: str, parents: DataFrame | None = None) -> DataFrame:
    """key, label, predicted: best prototype per query, ties to the smaller label.

    With parents (label, parent) only labels of the query's own parent compete,
    and parents with fewer than two labels are left out.  The prototypes are
    counted: within BLOCK_BYTES they travel to the executors and a query is
    scored where it lies; beyond that they are cut into blocks, every block meets
    all queries, and the best of the blocks counts.  Scores are matrix products
    of batches; a query without a vector has no row.
    """
    spark = queries.sparkSession
    q, p = queries.select(key, label, vector), protos
    if parents is not None:
        sized = parents.withColumn("_c", F.count("*").over(Window.partitionBy("parent"))).filter("_c >= 2").select(label, F.col("parent").cast("string").alias("_parent"))
        p, q = lookup_join(protos, sized, [label]), lookup_join(q, sized, [label])
    else:
        p, q = p.withColumn("_parent", F.lit("")), q.withColumn("_parent", F.lit(""))
    p = p.filter(f"`{label}` is not null").select(label, "proto", "_parent")
    q = q.filter(F.col(vector).isNotNull()).select(key, label, "_parent", F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    size = p.agg(F.count("*").alias("n"), F.max(F.size("proto")).alias("d")).head()
    blocks = max(1, -(-(size["n"] * (size["d"] or 1) * 8) // BLOCK_BYTES))

    def best(queries: pa.Table, labels: list, matrix: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, list]:
        x = np.array(queries.column("_v").to_pylist(), np.float64).reshape(len(queries), -1)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        scores = np.round(x @ matrix.T, 9)
        scores[np.array(queries.column("_parent").to_pylist())[:, None] != groups[None, :]] = -np.inf
        at = scores.argmax(1)  # labels are in order, so the first is the smaller one
        return scores[np.arange(len(at)), at], [labels[i] for i in at]

    def answer(queries: pa.Table, labels: list, matrix: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
        score, found = best(queries, labels, matrix, groups)
        out = pa.Table.from_arrays([queries.column(0).combine_chunks(), queries.column(1).combine_chunks(), pa.array(found, queries.schema.field(1).type), pa.array(score)], names=[key, label, "predicted", "_score"])
        return out.filter(pa.array(np.isfinite(score))).combine_chunks()

    kinds = dict(q.dtypes)
    schema = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, predicted {kinds[label]}, _score double"

    def scored(own: DataFrame) -> DataFrame:
        rows = sorted(((r[label], r["proto"], r["_parent"]) for r in own.collect()), key=lambda r: r[0])  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], object)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, matrix, groups = shared.value
            for batch in batches:
                for start in range(0, len(batch) if labels else 0, ROWS):
                    yield from answer(pa.Table.from_batches([batch.slice(start, ROWS)]), labels, matrix, groups).to_batches()

        return q.mapInArrow(score, schema)

    if blocks == 1:
        return scored(p).select(key, label, "predicted")
    held = Scratch(spark, "blocks").save(p.withColumn("_block", F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int")), "protos")
    parts = [Scratch(spark, "scored").save(scored(held.filter(F.col("_block") == b)), f"block-{b}") for b in range(blocks)]
    best_of = F.min(F.struct((-F.col("_score")).alias("s"), "predicted")).alias("b")
    return reduce(DataFrame.unionByName, parts).groupBy(key, label).agg(best_of).select(key, label, "b.predicted")


def macro_recall(predicted: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, macro_recall, n_classes, n_queries: mean over labels of the share predicted right."""
    per = predicted.groupBy(*keys, label).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("r"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.round(F.avg("r"), 6).alias("macro_recall"), F.count("*").alias("n_classes"), F.sum("n").alias("n_queries"))


def leakage(rows: DataFrame, species: str, group: str, vector: str) -> DataFrame:
    """same_species, same_group, margin: mean cosines of pairs that share one but not the other.

    Pairs are weighted as if a group were drawn first and then a pair in it:
    sum over groups of S/N over sum of V/N, with N all pairs of a group, V the
    valid ones and S their cosine sum.  The sums come from vector sums
    (|sum|^2 - sum |x|^2), so no pair is formed.
    """
    x = rows.select(species, group, unit(F.col(vector)).alias("u"))

    def sums(keys: list[str]) -> DataFrame:
        each = x.select(*keys, F.posexplode("u").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("s"))
        square = each.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
        count = x.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.aggregate("u", F.lit(0.0), lambda a, y: a + y * y)).alias("own"))
        return count.join(square, keys).select(*keys, (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), ((F.col("ss") - F.col("own")) / 2).alias("cos"))

    cell = sums([species, group])

    def side(key: str) -> DataFrame:
        inner = cell.groupBy(key).agg(F.sum("pairs").alias("ip"), F.sum("cos").alias("ic"))
        g = sums([key]).join(inner, key).filter("pairs > 0")
        return g.agg((F.sum((F.col("cos") - F.col("ic")) / F.col("pairs")) / F.nullif(F.sum((F.col("pairs") - F.col("ip")) / F.col("pairs")), F.lit(0.0))).alias("m"))

    a, b = side(species).select(F.round("m", 6).alias("same_species")), side(group).select(F.round("m", 6).alias("same_group"))
    both = a.join(F.broadcast(b))  # one row each
    return both.withColumn("margin", F.round(F.col("same_species") - F.col("same_group"), 6))


def linear_probe(train: DataFrame, test: DataFrame, key: str, label: str, vector: str, penalty: float = 1e-3, iterations: int = 100) -> DataFrame:
    """key, label, predicted of a multinomial probe: mean cross entropy + penalty * sum of squared weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def ready(df: DataFrame) -> DataFrame:
        return df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(unit(F.col(vector))).alias("features"))

    model = LogisticRegression(family="multinomial", regParam=2 * penalty, elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(ready(train))
    return model.transform(ready(test)).select(key, F.col("label").cast("int").alias(label), F.col("prediction").cast("int").alias("predicted"))
