"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each stored partition sends to each shard is drawn first, from counts alone: one row of
the matrix per partition, a multivariate hypergeometric draw from what the shards still lack. Within a
partition the rows get their shards by a random permutation, then they are exchanged once and permuted
again inside the shard. The result is a uniform permutation of the table, with shard sizes known before
any row moves.

The driver draws the matrix for groups of ``GROUP`` partitions only; a task draws the rows of its group out of the
group's. So what is sent to the tasks is one number per partition and one row of shards per group.

A shard is not one task: it is exchanged in pieces of bounded size, in rows and in bytes. The piece of a row is drawn
together with its shard, so the sizes of the pieces, and from them the first slot of each, come from the draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.columns import packed, quoted, unpacked, without
from webgauge.session import materialize

ROWS_PER_PIECE = 50_000
BYTES_PER_PIECE = 64 << 20
LEAST_PIECES = 16
GROUP = 64


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most; the first shards take the remainder."""
    return rows // shards + (np.arange(shards) < rows % shards)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """matrix[p, s]: rows that partition p sends to shard s; its margins are ``counts`` and ``sizes``."""
    rng, left = np.random.default_rng(seed), sizes.astype(np.int64).copy()
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, rows in enumerate(counts):
        total = int(left.sum())
        for s in range(len(sizes)):  # one margin after the other: exact for any number of rows
            if not rows:
                break
            take = _hypergeometric(rng, int(left[s]), total - int(left[s]), rows)
            matrix[p, s], total, rows = take, total - int(left[s]), rows - take
        left -= matrix[p]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw of any size, by inversion.

    Neighbouring probabilities have the ratio (good - k)(draws - k) / ((k + 1)(bad - draws + k + 1)); they are
    multiplied up from the mode to where the tail is below any double, and scaled by their sum. No factorial is
    needed, whose logarithm would lose all digits at 10^9 rows.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    deviation = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(12 * deviation) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log((bad - draws) + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


@dataclass(frozen=True)
class Plan:
    """The matrix as tasks need it: rows of each partition, and what each group of partitions sends to each shard."""

    partitions: np.ndarray
    counts: np.ndarray
    groups: np.ndarray
    seed: int

    @classmethod
    def draw(cls, counts: dict[int, int], shards: int, seed: int) -> Plan:
        order = sorted(counts)
        rows = np.array([counts[p] for p in order], dtype=np.int64)
        sums = np.add.reduceat(rows, np.arange(0, len(rows), GROUP)) if len(rows) else rows
        return cls(np.array(order, dtype=np.int64), rows, communication_matrix(sums.tolist(), shard_sizes(int(rows.sum()), shards), seed), seed)

    def row(self, partition: int) -> np.ndarray:
        """Rows that a partition sends to each shard."""
        at = int(np.searchsorted(self.partitions, partition))
        group = at // GROUP
        own = self.counts[group * GROUP : (group + 1) * GROUP]
        return communication_matrix(own[: at % GROUP + 1].tolist(), self.groups[group], [self.seed, group])[-1]


def _targets(partition: int, row: np.ndarray, pieces: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, piece and random key of each row of a partition, in stored order."""
    rng = np.random.default_rng([seed, partition])
    shard = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
    key = rng.integers(0, 1 << 62, len(shard), dtype=np.int64)
    return shard, ((key >> 32) * pieces >> 30).astype(np.int32), key


def _deal(batches: Iterator[pa.RecordBatch], plan: Broadcast, pieces: int, seed: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple] = {}
    for batch in batches:
        partition, place = (batch.column(c).to_numpy() for c in ("_part", "_row"))
        shard, piece, key = np.empty(len(place), np.int32), np.empty(len(place), np.int32), np.empty(len(place), np.int64)
        for p in np.unique(partition).tolist():
            if p not in held:
                held = {p: _targets(p, plan.value.row(p), pieces, seed)}  # files hold one partition each: seldom redrawn
            mine = partition == p
            for out, drawn in zip((shard, piece, key), held[p]):
                out[mine] = drawn[place[mine]]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(piece), pa.array(key)], [*names, "_shard", "_piece", "_key"])


def _bytes(df: DataFrame, columns: list[str]) -> Column:
    """About the size of a row: the text of its columns and a word for each."""
    total = F.lit(8 * len(columns)).cast("long")
    for c in columns:
        kind, value = df.schema[c].dataType, F.col(quoted(c))
        if isinstance(kind, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(kind, T.ArrayType | T.MapType):
            total = total + 16 * F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0))
    return total


def shard_rows(df: DataFrame, shards: int, *, seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row of ``df`` with its ``shard`` (0 to ``shards`` - 1) and its ``slot`` in it (gapless from 0).

    Shard sizes differ by one at most. Each assignment of rows to slots is equally likely, up to the
    64-bit seed; the same stored input and seed give the same result. Nulls, long texts and repeated
    rows need no care: a row is known by its place in the stored copy of the input. An empty table gives
    an empty result; columns called ``shard`` or ``slot`` are replaced, others pass through whatever their names.

    The input is stored once, so that a lost executor finds every row at the same place again.
    """
    kept = without(df, shard, slot)
    place = F.monotonically_increasing_id()
    part = F.shiftright(place, 33).cast("int").alias("_part")
    row = place.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("_row")
    stored = materialize(df.select(packed(df, kept), part, row, _bytes(df, kept).alias("_bytes")))
    sizes = {r["_part"]: (r["n"], r["b"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).toLocalIterator()}
    rows, size = (sum(s[k] for s in sizes.values()) for k in (0, 1))
    spark = df.sparkSession
    plan = spark.sparkContext.broadcast(Plan.draw({p: s[0] for p, s in sizes.items()}, shards, seed))
    pieces = max(LEAST_PIECES, -(-rows // (shards * ROWS_PER_PIECE)), -(-size // (shards * BYTES_PER_PIECE)))
    offsets = _first_slots(spark, plan, pieces, seed, len(sizes))
    source = stored.select("row", "_part", "_row")
    schema = T.StructType([*source.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_piece", T.IntegerType()), T.StructField("_key", T.LongType())])
    dealt = source.mapInArrow(lambda batches: _deal(batches, plan, pieces, seed), schema)
    within = F.row_number().over(W.partitionBy("_shard", "_piece").orderBy("_key", "_part", "_row"))
    placed = dealt.withColumn("_in", within).join(offsets, ["_shard", "_piece"])
    return placed.select(*unpacked(kept), F.col("_shard").alias(shard), (F.col("_first") + F.col("_in") - 1).cast("long").alias(slot))


def _first_slots(spark: SparkSession, plan: Broadcast, pieces: int, seed: int, partitions: int) -> DataFrame:
    """(_shard, _piece, _first): the slot before each piece. Redraws the targets in tasks; reads no table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in plan.value.partitions[batch.column(0).to_numpy()].tolist():
                shard, piece, _ = _targets(p, plan.value.row(p), pieces, seed)
                cell, n = np.unique(shard.astype(np.int64) * pieces + piece, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((cell // pieces).astype(np.int32)), pa.array((cell % pieces).astype(np.int32)), pa.array(n)], ["_shard", "_piece", "_n"])

    drawn = spark.range(0, partitions, 1, max(1, min(partitions, 4 * spark.sparkContext.defaultParallelism)))
    sizes = drawn.mapInArrow(count, "_shard int, _piece int, _n long").groupBy("_shard", "_piece").agg(F.sum("_n").alias("_n"))
    # One row per piece of a shard: bounded by the pieces, not by the rows.
    before = W.partitionBy("_shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    return materialize(sizes.select("_shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
