"""Mixing sources to target weights, in fixed-length token blocks.

Tokens of each source are packed into blocks; per output shard a multinomial
draw, given exact totals for every group of shards, says how many slots each
source gets; the slots of a source run through pseudorandom permutations of its
block numbers, one per pass; blocks join their slots by number.  No pass exceeds
a source's max_repeats.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import snake_name
from tidemark.llm.batches import chunks
from tidemark.operators.joins import lookup_join
from tidemark.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 512  # tokens
SHARD_BLOCKS = 64  # slots of an output shard
RANGE_TOKENS = 1 << 20  # tokens of a hash range, which one task orders and packs at once
GROUP_SHARDS = 64  # output shards whose totals are exact
PREFIX = 4096  # hash ranges whose running count one task takes
ROUNDS = 4  # of the Feistel permutation
# fixed value: the public pre-tokenisation pattern that belongs to the vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("blocks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenise(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, tokens, n): each document; null and empty texts have no tokens and are left out.

    The source is spelled as in the targets.  The vocabulary file is sent to the
    executors by Spark; texts are tokenised where they are read.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in chunks(texts):
                tokens = [np.array(enc.encode_ordinary(t), np.int32) for t in texts[part]]
                sizes = np.array([len(t) for t in tokens], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(tokens)))
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists, pa.array(sizes)], names=["source", "doc_id", "tokens", "n"])

    named = documents.filter("doc_id is not null and length(text) > 0").select(snake_name("source").alias("source"), "doc_id", "text").filter("source is not null")
    return named.mapInArrow(run, "source string, doc_id long, tokens array<int>, n long")


def pack(scratch: Scratch, tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block_no, tokens, n_tokens): each source's tokens in blocks of ``block``.

    A source has as many hash ranges as its tokens fill at RANGE_TOKENS each, so
    a source with a third of all rows is spread like any other.  A range is
    ordered and cut into blocks in one pass, its last block is shorter; tokens
    are shuffled once.  A repeat of a doc_id within its source counts once: it
    follows its equal in the order.
    """
    sizes = tokens.groupBy("source").agg(F.sum("n").alias("total"))  # one row per source
    ranges = sizes.select("source", F.greatest(F.lit(1), F.ceil(F.col("total") / RANGE_TOKENS)).cast("int").alias("ranges"))
    h = F.xxhash64("source", "doc_id")
    ranged = tokens.join(F.broadcast(ranges), "source").withColumn("h", h).withColumn("range", F.pmod("h", "ranges").cast("int"))
    ordered = ranged.select("source", "range", "h", "doc_id", "n", "tokens").repartition("source", "range").sortWithinPartitions("source", "range", "h", "doc_id", "n", "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, number, held, out = None, None, 0, np.empty(0, np.int32), []

        def settle(final: bool) -> None:
            nonlocal held, number
            whole = len(held) // block
            pieces = [held[i * block : (i + 1) * block] for i in range(whole)]
            held = held[whole * block :]
            if final and len(held):
                pieces.append(held)
                held = np.empty(0, np.int32)
            out.extend((*at, number + i, p) for i, p in enumerate(pieces))
            number += len(pieces)

        def ready() -> pa.RecordBatch:
            source, range_, index, pieces = zip(*out, strict=True)
            offsets = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            columns = [pa.array(source), pa.array(range_, pa.int32()), pa.array(index, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces)))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["source", "range", "index", "tokens"])

        for batch in batches:
            places = batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy(zero_copy_only=False)
            for i, (source, range_, doc_id) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if (source, range_) != at:
                    if at is not None:
                        settle(True)
                    at, last, number = (source, range_), None, 0
                if doc_id != last:
                    held = np.concatenate([held, values[places[i] : places[i + 1]]]) if len(held) else values[places[i] : places[i + 1]].copy()
                    settle(False)
                    last = doc_id
            if out:
                yield ready()
        if at is not None:
            settle(True)
        if out:
            yield ready()

    cut_up = scratch.save(ordered.select("source", "range", "doc_id", "n", "tokens").mapInArrow(cut, "source string, range int, index long, tokens array<int>"), "pieces")
    # the first block number of each range, by running counts within PREFIX ranges and over these
    counts = cut_up.groupBy("source", "range").agg(F.count("*").alias("c")).withColumn("part", F.floor(F.col("range") / PREFIX))
    within = F.coalesce(F.sum("c").over(Window.partitionBy("source", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("source", "part").agg(F.sum("c").alias("c"))
    parts = parts.select("source", "part", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = scratch.save(counts.withColumn("within", within).join(parts, ["source", "part"]).select("source", "range", (F.col("before") + F.col("within")).alias("start")), "starts")
    numbered = lookup_join(cut_up, starts, ["source", "range"])
    return numbered.select("source", (F.col("start") + F.col("index")).alias("block_no"), "tokens", F.size("tokens").alias("n_tokens"))


def scramble(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a multiply and shift hash, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Places of the indices in a keyed pseudorandom permutation of 0..size-1.

    A Feistel network on a grid of a by b places: each round adds a hash of one
    part to the other.  A result beyond size is put in again (cycle walking);
    the grid has fewer than a places too many, so few are.
    """
    a = int(np.ceil(np.sqrt(size)))
    b = -(-size // a)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] // np.uint64(b), x[todo] % np.uint64(b)
        for r in range(ROUNDS):
            salt = np.uint64((key * 2 * ROUNDS + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            if r % 2:
                right = (right + scramble(left ^ salt) % np.uint64(b)) % np.uint64(b)
            else:
                left = (left + scramble(right ^ salt) % np.uint64(a)) % np.uint64(a)
        x[todo] = left * np.uint64(b) + right
        todo = x >= size
    return x.astype(np.int64)


def shares_for(targets: dict[str, float], tokens: dict[str, int], blocks: dict[str, int], repeats: dict[str, int]) -> tuple[dict[str, float], int]:
    """(share of the slots of each source that has blocks, most slots in all so that none exceeds its repeats).

    The shares are such that the tokens, not the slots, follow the targets: a
    source whose blocks hold fewer tokens on average has more slots.
    """
    present = {s: w * blocks[s] / tokens[s] for s, w in targets.items() if blocks.get(s) and tokens.get(s) and w > 0 and repeats.get(s, 1) > 0}
    total = sum(present.values())
    share = {s: w / total for s, w in sorted(present.items())}
    if not share:
        return share, 0
    slots = int(min(repeats.get(s, 1) * blocks[s] / w for s, w in share.items()))
    # the largest source takes what the others' parts leave in rounding, less than one slot for each of them
    big = largest(share)
    rest = len(share) - 1
    slots = min(slots, max(int((repeats.get(big, 1) * blocks[big] - rest) / share[big]), repeats.get(big, 1) * blocks[big] if not rest else 0))
    return share, max(slots, 0)


def largest(share: dict[str, float]) -> str:
    return max(share, key=lambda s: (share[s], s))


def upto(share: dict[str, float], slots: int) -> np.ndarray:
    """Slots of each source (in the order of share) among the first ``slots``: the share rounded down, the largest source has the rest."""
    out = np.array([int(np.floor(w * slots * (1 + 1e-15))) for w in share.values()], np.int64)
    big = list(share).index(largest(share))
    out[big] += slots - out.sum()
    return out


def group_size(share: dict[str, float]) -> int:
    """Slots of a group of shards: so many that the largest source has enough of each to give way in rounding."""
    return SHARD_BLOCKS * max(GROUP_SHARDS, -(-len(share) ** 2 // SHARD_BLOCKS))


def draw_group(share: dict[str, float], slots: int, group: int, seed: int = 0) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, number of slots of each source) of the shards of a group.

    The group's totals follow the shares exactly; given these, the shards' counts
    are a multinomial draw.  Any group is drawn on its own.
    """
    size = group_size(share)
    low, high = min(slots, group * size), min(slots, (group + 1) * size)
    first, end = upto(share, low), upto(share, high)
    left, rng, out = end - first, np.random.default_rng([seed, group]), []
    for start in range(low, high, SHARD_BLOCKS):
        got = rng.multivariate_hypergeometric(left, min(SHARD_BLOCKS, high - start))
        out.append((start // SHARD_BLOCKS, first, got))
        first, left = first + got, left - got
    return out


def pass_key(source: str, number: int, seed: int) -> int:
    """64-bit key of the permutation of a source's blocks in one pass."""
    return int.from_bytes(hashlib.blake2b(f"{seed}|{number}|{source}".encode(), digest_size=8).digest(), "big")


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK, tokenizer: str = TOKENIZER) -> DataFrame:
    """(shard, slot, source, pass_no, block_no, n_tokens, tokens): the mixed blocks.

    The total is the largest for which every source with documents reaches its
    share within max_repeats (null is one); a source without documents has no
    slots and the others share its weight.  Null weights count as none, repeated
    targets once.  Empty tables give no row.
    """
    scratch = Scratch(spark, "mix")
    rows = targets.select(snake_name("source").alias("s"), "target_share", "max_repeats").filter("s is not null").collect()  # one row per source
    weight = {r["s"]: float(r["target_share"] or 0) for r in rows}
    repeats = {r["s"]: int(1 if r["max_repeats"] is None else r["max_repeats"]) for r in rows}
    listed = snake_name("source").isin(*weight) if weight else F.lit(False)
    tokens = scratch.save(tokenise(documents.filter(listed), tokenizer), "tokens")
    packed = pack(scratch, tokens, block)
    scratch.drop("tokens")
    have = packed.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens")).collect()  # one row per source
    blocks = {r["source"]: int(r["blocks"]) for r in have}
    share, slots = shares_for(weight, {r["source"]: int(r["tokens"]) for r in have}, blocks, repeats)
    names = list(share)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in batches:
            for group in groups["id"]:
                frames = []
                for shard, first, got in draw_group(share, slots, int(group), seed):
                    source = np.repeat(np.arange(len(names)), got)
                    k = np.concatenate([np.arange(f, f + n) for f, n in zip(first, got, strict=True)])
                    slot = np.random.default_rng([seed, int(group), shard]).permutation(len(k))
                    frames.append(pd.DataFrame({"shard": shard, "slot": slot.astype(np.int32), "source": source, "k": k}))
                frame = pd.concat(frames)
                for i, own in frame.groupby("source"):
                    size = blocks[names[i]]
                    k = own["k"].to_numpy()
                    passes, out = k // size, np.empty(len(k), np.int64)
                    for p in np.unique(passes):
                        out[passes == p] = permuted(k[passes == p] % size, size, pass_key(names[i], int(p), seed))
                    yield pd.DataFrame({"shard": own["shard"].to_numpy(), "slot": own["slot"].to_numpy(), "source": names[i], "pass_no": passes.astype(np.int32), "block_no": out})

    groups = -(-slots // group_size(share)) if share else 0
    spread = max(1, min(groups, 4 * spark.sparkContext.defaultParallelism))
    each = spark.range(groups, numPartitions=spread).mapInPandas(place, "shard long, slot int, source string, pass_no int, block_no long")
    return each.join(packed, ["source", "block_no"]).select("shard", "slot", "source", "pass_no", "block_no", "n_tokens", "tokens")


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, most_repeats) of every target, sources without documents with 0."""
    per_block = mixed.groupBy("source", "block_no").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("tokens"))
    per = per_block.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("times").alias("most_repeats"))
    named = targets.select(snake_name("source").alias("source"), "target_share").filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    all_ = named.join(per, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row per source
    return all_.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))
