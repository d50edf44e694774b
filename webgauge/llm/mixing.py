"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source that should make up a share w of the mixed corpus has the mean repetition rate
w * (size of all sources) * epochs / (its size). Each document draws its number of copies from the Poisson
distribution with that mean, by inverting it at a uniform number hashed from the document and the seed;
then the documents are exploded by their counts and shuffled globally by another hash.

Nothing depends on partitions, so a lost executor or another cluster gives the same corpus. The only
join is with one row per source, stored first so that the planner knows its size: it is broadcast if
it is below the session's threshold, and otherwise joined by shuffle, where Spark splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.llm.columns import packed, quoted, unpacked, without
from webgauge.session import materialize

#: Larger means are drawn as a sum of independent parts, as exp(-mean) must stay a normal number.
LARGEST_PART = 64.0
TWO_52 = float(1 << 52)


def document_size(text: str) -> Column:
    """UTF-8 bytes and one end mark, so that no source has the size 0."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(1)


def repetition_rates(docs: DataFrame, weights: DataFrame | None, *, source: str, text: str, epochs: float) -> DataFrame:
    """One row per source: its mean number of copies and the Poisson distribution of one part of it."""
    sized = docs.select(F.col(quoted(source)).alias("_source"), document_size(quoted(text)).alias("_bytes"))
    sizes = sized.groupBy("_source").agg(F.sum("_bytes").cast("double").alias("_size"))
    if weights is None:
        weighted = sizes.withColumn("_weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("_name")).agg(F.sum("weight").cast("double").alias("_weight"))
        weighted = sizes.join(w, F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name").fillna(0.0, ["_weight"])
    weighted = materialize(weighted)
    sums = weighted.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    rate = F.when(F.col("_weight") > 0, F.col("_weight") / F.col("_weights") * F.col("_all") * F.lit(epochs) / F.col("_size")).otherwise(F.lit(0.0))
    parts = F.greatest(F.ceil(F.col("_rate") / LARGEST_PART), F.lit(1)).cast("int")
    rated = weighted.join(F.broadcast(sums)).select("_source", rate.alias("_rate")).withColumn("_parts", parts)
    mean = F.col("_rate") / F.col("_parts")
    first = F.exp(-mean)

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), F.concat(state["all"], F.array(state["c"] + p)).alias("all"))

    last = (mean + F.sqrt(mean) * 12 + 30).cast("int")
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    return rated.withColumn("_below", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"]))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / TWO_52


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source", text: str = "text", doc: str = "doc_id", epochs: float = 1.0, seed: int = 0, details: bool = False) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its draw says, in globally shuffled order.

    ``weights`` (source, weight) are the target shares of the bytes, not necessarily adding up to one;
    without it all sources get the same share. Sources without a weight are left out; weights of sources that
    do not occur count in the sum, so their share stays empty. A null source is a source of its own.
    The expected size is ``epochs`` times the size of ``docs``.

    A row is known by its id and text: repeated rows draw the same count. Null ids and null or empty
    texts are rows like others. An empty table gives an empty result. Columns pass through;
    ``details`` adds n_copies, copy (0 to n_copies - 1) and place, the hash that rows are ordered by.
    """
    kept = without(docs, "n_copies", "copy", "place") if details else docs.columns
    rates = materialize(repetition_rates(docs, weights, source=source, text=text, epochs=epochs))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(quoted(doc)).cast("string"), F.col(quoted(text))))
    keyed = docs.select(packed(docs, kept), F.col(quoted(source)).alias("_name"), key.alias("_key"))
    joined = keyed.join(rates, F.col("_name").eqNullSafe(F.col("_source")))
    # The numbers of a document, one per part, are hashed before they meet the distribution.
    numbers = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda part: uniform(F.concat_ws("|", F.col("_key"), part.cast("string"))))
    drawn = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter("_below", lambda below: below <= u)))
    counted = joined.select("row", "_key", drawn.alias("_n")).where(F.col("_n") > 0)
    copies = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    placed = copies.withColumn("_place", F.md5(F.concat_ws("|", F.col("_key"), F.lit("copy"), F.col("_copy").cast("string"))))
    shuffled = placed.repartition("_place").sortWithinPartitions("_place")
    more = [F.col("_n").alias("n_copies"), F.col("_copy").alias("copy"), F.col("_place").alias("place")] if details else []
    return shuffled.select(*unpacked(kept), *more)
