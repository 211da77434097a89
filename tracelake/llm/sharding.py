"""Uniform shuffle into shards of exact sizes (hypergeometric communication matrix).

For every source partition and target block an exact count is drawn: how many of
its rows go there.  The matrix of counts follows the law that a uniform shuffle
of all rows would give it.  It is never built whole: halving the partitions again
and again, each half's counts are one multivariate hypergeometric draw with a
seed of its own, so every task finds its own row of the matrix in log(partitions)
draws from nothing but the partitions' row counts.  Rows are permuted inside
their partition, dealt by those counts, exchanged by block, and permuted again
inside the block.  A shard is one or more blocks of at most `block_rows` rows,
so no task holds a shard; sizes of shards differ by one row at most.

The rows themselves, texts included, are stored with their partition and place,
and exchanged and sorted by Spark; Python sees partitions, places and ranks
only.  Where a row goes follows from the seed, its partition and its place: the
same table read in other partitions is shuffled otherwise, as uniformly.

Defined cases.  Null text: size 1, CRC of nothing.  Empty table: no rows.  Fewer
rows than shards: the last shards are empty.  Repeated rows are rows like others.
Null ids stay null; extra columns stay as they are in `shuffled`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

SHARDS, SEED, BLOCK_ROWS = 16, 7, 1 << 14


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw; the library's where it reaches, else by inversion around the mode."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(n, good)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    width = 40 + int(14 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))))
    x = np.arange(max(lo, mode - width), min(hi, mode + width) + 1, dtype=np.float64)
    steps = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[1:]) - np.log(bad - n + x[1:])
    weight = np.append(0.0, np.cumsum(steps))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return int(x[min(np.searchsorted(weight, rng.random() * weight[-1]), len(x) - 1)])


def _multivariate(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn without replacement, go to each block with so much room."""
    if room.sum() < 10**9:
        return rng.multivariate_hypergeometric(room, n, method="marginals").astype(np.int64)
    out, rest = np.zeros_like(room), int(room.sum())
    for i, r in enumerate(room.tolist()):
        rest -= r
        out[i] = _hypergeometric(rng, r, rest, n)
        n -= int(out[i])
    return out


def matrix_row(part: int, before: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """Counts of rows that a partition sends to each block; before: rows in all partitions before it, and the total last."""
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1, lo, hi])))
        left = _multivariate(rng, room, int(before[mid] - before[lo]))
        room, lo, hi = (left, lo, mid) if part < mid else (room - left, mid, hi)
    return room


def blocks(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of every block."""
    size = rows // shards + (np.arange(shards) < rows % shards)
    shard, first, room = [], [], []
    for s, n in enumerate(size.tolist()):
        k = max(1, -(-n // block_rows))
        part = n // k + (np.arange(k) < n % k)
        shard += [s] * k
        first += (np.cumsum(part) - part).tolist()
        room += part.tolist()
    return np.array(shard), np.array(first), np.array(room, np.int64)


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns, and shard (int) and slot (long): a uniform permutation of the rows, cut into shards."""
    names = rows.columns
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    number = F.monotonically_increasing_id()  # a row's partition, and its place there in the lower 33 bits
    # stored: from here on a row's partition and place are data, whatever is lost and run again
    placed = stored(packed.withColumn("part", F.spark_partition_id()).withColumn("place", number.bitwiseAND((1 << 33) - 1)), "placed")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    parts = sorted(counts)
    index = {p: i for i, p in enumerate(parts)}
    before = np.append(0, np.cumsum([counts[p] for p in parts])).astype(np.int64)
    shard, first, room = blocks(int(before[-1]), shards, block_rows)
    shared = rows.sparkSession.sparkContext.broadcast((index, before, first, room))

    def deal(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The block of each row, from its partition and place."""
        index, before, _, room = shared.value
        known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int32))
        for part, place in columns:
            part, place = part.to_numpy(), place.to_numpy()
            block = np.empty(len(part), np.int32)
            for p in np.unique(part).tolist():
                if known[0] != p:
                    i = index[p]
                    to = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(i, before, room, seed))
                    known = (p, np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 2, i]))).permutation(to))
                block[part == p] = known[1][place[part == p]]
            yield pd.Series(block)

    def permute(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The slot of each row, from its block and rank there."""
        _, _, first, room = shared.value
        known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        for block, rank in columns:
            block, rank = block.to_numpy(), rank.to_numpy()
            slot = np.empty(len(block), np.int64)
            for b in np.unique(block).tolist():
                if known[0] != b:
                    known = (b, np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 3, b]))).permutation(int(room[b])) + int(first[b]))
                slot[block == b] = known[1][rank[block == b] - 1]
            yield pd.Series(slot)

    dealt = placed.withColumn("block", F.pandas_udf(deal, "int")("part", "place"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("part", "place")))
    out = ranked.withColumn("slot", F.pandas_udf(permute, "long")("block", "rank"))
    of = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))  # the first block of each shard
    shard_of = F.size(F.filter(F.lit([int(x) for x in of]), lambda x: x <= F.col("block"))) - 1
    keep = [c for c in names if c not in ("shard", "slot")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], shard_of.cast("int").alias("shard"), "slot")


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The operator's own files: a folder for each shard, whose rows carry their slots."""
    out = shuffled(rows, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, measured where the rows arrive."""
    rows = shuffled(docs.select("doc_id", "text"), shards, seed)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
