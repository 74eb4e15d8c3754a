"""Percentiles from mergeable sketches: randomised compactor hierarchies.

A sketch is a list of levels; an item of level h stands for 2**h values.  A
full level is sorted and every second item (random offset) moves one level up.
Sketches of partitions, builds or days merge level by level.  With k items at
the top level the rank error stays below ``rank_error(k)`` of n in 99 % of
answers; a sketch that never compacted (n below its capacity) is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 4096
SHRINK = 2 / 3  # capacity of a level against the one above
LEAST = 8


def rank_error(k: int = K) -> float:
    """Rank error, as a share of n, that 99 % of answers keep to."""
    return 2.296 / k**0.9021


def capacity(level: int, levels: int, k: int) -> int:
    return max(LEAST, int(np.ceil(k * SHRINK ** (levels - 1 - level))))


def compress(levels: list[np.ndarray], k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Compacts full levels, lowest first, until all fit in the total capacity."""
    levels = list(levels) or [np.empty(0)]
    while sum(map(len, levels)) > sum(capacity(h, len(levels), k) for h in range(len(levels))):
        for h in range(len(levels)):
            if len(levels[h]) > capacity(h, len(levels), k):
                if h + 1 == len(levels):
                    levels.append(np.empty(0))
                items = np.sort(levels[h])
                keep, items = (items[:1], items[1:]) if len(items) % 2 else (items[:0], items)
                levels[h + 1] = np.concatenate([levels[h + 1], items[rng.integers(2) :: 2]])
                levels[h] = keep
                break
    return levels


def sketch(values: np.ndarray, k: int = K, seed: int = 0) -> list[np.ndarray]:
    """Sketch of one array, taken in blocks so that memory stays bounded."""
    rng, levels = np.random.default_rng(seed), [np.empty(0)]
    for start in range(0, len(values), 8 * k):
        levels[0] = np.concatenate([levels[0], values[start : start + 8 * k]])
        levels = compress(levels, k, rng)
    return levels


def merge(sketches: list[list[np.ndarray]], k: int = K, seed: int = 0) -> list[np.ndarray]:
    top = max(map(len, sketches), default=0)
    joined = [np.concatenate([s[h] for s in sketches if h < len(s)]) for h in range(top)]
    return compress(joined, k, np.random.default_rng(seed))


def at_ranks(levels: list[np.ndarray], shares: np.ndarray) -> np.ndarray:
    """Values at ranks ceil(share * n), the lower of the usual definitions; NaN where empty."""
    items = np.concatenate(levels) if levels else np.empty(0)
    if not len(items):
        return np.full(len(shares), np.nan)
    weights = np.concatenate([np.full(len(x), 2.0**h) for h, x in enumerate(levels)])
    order = np.argsort(items, kind="stable")
    cumulative = np.cumsum(weights[order])
    at = np.searchsorted(cumulative, np.clip(np.ceil(np.clip(shares, 0, 1) * cumulative[-1]), 1, None))
    return items[order][np.minimum(at, len(items) - 1)]


def _encode(sketches: list[list[np.ndarray]]) -> pa.ListArray:
    inner = [np.asarray(level, float) for levels in sketches for level in levels]
    outer_at = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
    inner_at = np.cumsum([0, *map(len, inner)]).astype(np.int32)
    values = pa.array(np.concatenate(inner) if inner else np.empty(0), pa.float64())
    return pa.ListArray.from_arrays(pa.array(outer_at), pa.ListArray.from_arrays(pa.array(inner_at), values))


def _cut(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(bounds of each row, flat values) of a list column without nulls."""
    at = column.offsets.to_numpy()
    return at - at[0], column.values.slice(at[0], at[-1] - at[0])


def _decode(column: pa.Array) -> list[list[np.ndarray]]:
    outer, levels = _cut(column)
    inner, values = _cut(levels)
    flat = values.to_numpy(zero_copy_only=False)
    return [[flat[inner[j] : inner[j + 1]] for j in range(a, b)] for a, b in zip(outer[:-1], outer[1:], strict=True)]


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", " + more


FLUSH = 1 << 18  # rows that a task holds before it sorts them into sketches


def build_sketches(values: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One partial sketch per key and partition: keys, n, levels array<array<double>>.

    Null and NaN values are no measurements.  Nothing is shuffled, so a key that
    holds a third of all rows costs each task only its share; an empty table
    gives no sketch.
    """

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # key: n, levels
        schema: list = []

        def settle(rows: pa.Table) -> None:
            codes = np.zeros(len(rows), np.int64)
            for c in keys:
                own, levels = pd.factorize(rows.column(c).to_pandas(), use_na_sentinel=False)
                codes = codes * len(levels) + own
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            data = rows.column(value).to_numpy()[order]
            heads = [rows.column(c).take(pa.array(order[starts])).to_pylist() for c in keys]
            for key, part in zip(zip(*heads, strict=True), np.split(data, starts[1:]), strict=True):
                own = held.setdefault(key, [0, [np.empty(0)]])
                rng = np.random.default_rng(own[0])
                for start in range(0, len(part), 8 * k):
                    own[1][0] = np.concatenate([own[1][0], part[start : start + 8 * k]])
                    own[1] = compress(own[1], k, rng)
                own[0] += len(part)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            schema = batch.schema
            waiting.append(batch)
            if sum(map(len, waiting)) >= FLUSH:
                settle(pa.Table.from_batches(waiting))
                waiting = []
        if waiting and sum(map(len, waiting)):
            settle(pa.Table.from_batches(waiting))
        if held:
            columns = list(zip(*held, strict=True))
            arrays = [pa.array(c, schema.field(name).type) for name, c in zip(keys, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x[0] for x in held.values()], pa.int64()), _encode([x[1] for x in held.values()])], names=[*keys, "n", "levels"])

    clean = values.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    return clean.mapInArrow(partials, _schema(values, keys, "n long, levels array<array<double>>"))


def merge_sketches(partials: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merges all sketches of a key; what a key gathers is bounded by its number of sketches times about 3k items."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = _cut(batch.column(len(keys) + 1))
            decoded = _decode(parts)
            seeds = batch.column(len(keys)).to_pylist()
            merged = [decoded[a] if b - a == 1 else merge(decoded[a:b], k, n) for a, b, n in zip(at[:-1], at[1:], seeds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys) + 1)), _encode(merged)], names=[*keys, "n", "levels"])

    gathered = partials.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("levels").alias("parts"))
    return gathered.mapInArrow(join, _schema(partials, keys, "n long, levels array<array<double>>"))


def percentiles(sketches: DataFrame, keys: list[str], shares: dict[str, float], k: int = K) -> DataFrame:
    """keys, n, and for each name of shares the value with its bounds ``<name>_low`` and ``<name>_high``.

    The bounds are the values at the ranks rank_error(k) below and above, one
    rank at least, so that they enclose every usual definition of a percentile;
    a sketch that never compacted gives the exact value.
    """
    names = [f"{x}{end}" for x in shares for end in ("", "_low", "_high")]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty((len(batch), len(names)))
            for i, levels in enumerate(_decode(batch.column(len(keys) + 1))):
                n = sum(len(x) << h for h, x in enumerate(levels))
                e = max(rank_error(k) if len(levels) > 1 else 0.0, 1 / max(n, 1))
                rows[i] = at_ranks(levels, np.array([s + d for s in shares.values() for d in (0.0, -e, e)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys) + 1)), *(pa.array(rows[:, j]) for j in range(len(names)))], names=[*keys, "n", *names])

    return sketches.select(*keys, "n", "levels").mapInArrow(answer, _schema(sketches, keys, "n long, " + ", ".join(f"{x} double" for x in names)))
