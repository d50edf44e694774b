"""Joins and rankings that keep working when one key or one group holds a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgauge.session import materialize

#: Bounds of the share of rows that makes a key hot.
MOST_SHARE, LEAST_SHARE = 0.01, 0.0001


def key_of(*parts: str) -> Column:
    """One text key from several columns; null when any part is null."""
    present = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])
    return F.when(present, F.concat_ws("\u0001", *parts))


def hot_share(df: DataFrame) -> float:
    """What an even shuffle partition holds, within bounds: a key above it would make its partition stand out."""
    even = 1.0 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SHARE, max(LEAST_SHARE, even))


def hot_keys(df: DataFrame, key: str) -> list[str]:
    """Every key with more than the hot share of the rows, and never more keys than one over that share.

    ``freqItems`` guarantees both in one pass without a shuffle of the keys; it may add cooler keys,
    which only changes how those are joined.
    """
    row = df.where(F.col(key).isNotNull()).select(key).stat.freqItems([key], hot_share(df)).first()
    return list(row[0])


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``left`` with a table that is unique on ``key``; left keys are not null.

    Rows with a hot key are answered by a broadcast of one row per hot key, 10,000 at most; all others meet
    in the shuffle, where no key has more than the hot share of the rows left. ``left`` is evaluated
    twice, so it should be cheap to derive from a stored table.
    """
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how).select(*columns)
    is_hot = F.col(key).isin(hot)
    of_hot = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    of_rest = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return of_hot.select(*columns).unionByName(of_rest.select(*columns))


def ranked(df: DataFrame, order: list[Column], group: str | None = None, name: str = "rank") -> DataFrame:
    """Exact row number in ``order``, per ``group`` if given, without gathering a group in one task.

    Rows are range-sorted over the cluster and stored with their place; only the row counts per stored
    partition are added up, one small row each.
    """
    keys = ([F.col(group)] if group else []) + order
    placed = materialize(df.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    parts = placed.withColumn("_part", part)
    by = ["_part"] + ([group] if group else [])
    counts = parts.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # One row per stored partition and group: ordering those is bounded by the number of partitions.
    before = W.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = parts.join(offsets, by)
    return numbered.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("long").alias(name))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their rank.

    As far as the session lets Spark limit window groups, ``n`` rows per group and map task are left before
    the shuffle; beyond that the rank comes from the range sort. The rows are the same either way.
    """
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
        return df.withColumn(name, rank.cast("long")).where(F.col(name) <= n)
    return ranked(df, order, group, name).where(F.col(name) <= n)
