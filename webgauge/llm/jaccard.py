"""Jaccard join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

1. Each text becomes the set of its 64-bit shingle hashes (five words), and a signature of MinHash values.
   Texts with the same set form one class, which goes on as one row.
2. Classes that agree in one band of the signature meet in a bucket. A bucket above a fixed amount of
   shingles is dealt into blocks, and every pair of its blocks is a unit of work of its own, so a hot
   bucket is spread over many tasks and no task holds more than two blocks.
3. In a unit, MinHash values are compared some at a time; a pair is dropped as soon as the posterior probability
   that it reaches the threshold falls below a tolerance. A pair that meets in several bands is
   looked at in the first one only.
4. Classes with a pair left fetch their text, and those pairs are verified exactly on their shingles.

A unit gives back the number of links of each class and a spanning forest of its links, never the
pairs, so rows grow with the classes and not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import Words, mix, slices
from webgauge.llm.columns import packed, quoted, unpacked
from webgauge.llm.components import connected
from webgauge.llm.units import root_of, to_batch, units
from webgauge.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
#: Two classes of similarity s share a band with probability 1 - (1 - s^5)^24: 0.99992 at 0.8.
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: A pair is dropped when it reaches the threshold with less probability than this.
TOLERANCE = 1e-6
STEP = 12
#: Most shingles and classes of a block, on average; a longer text is one block.
BLOCK_SHINGLES = 200_000
BLOCK_CLASSES = 2_000
PAIRS_AT_ONCE = 200_000

SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def shingles_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text begins.

    A text with fewer words than ``size``, but one at least, is one shingle; a text without words has none.
    """
    words = Words(column)
    n = len(words.hash)
    take = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
    begin = words.first[:-1]
    place = np.repeat(begin - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
    row = np.repeat(np.arange(len(take)), take)
    end = np.minimum(place + size, words.first[row + 1])
    value = np.zeros(len(place), dtype=np.uint64)
    for k in range(size):
        at = place + k
        inside = at < end
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words.hash[np.minimum(at, max(n - 1, 0))] if n else 0, np.uint64(k)).astype(np.uint64))
    sets, starts = [], np.zeros(len(take) + 1, dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(take)])
    for k in range(len(take)):
        own = np.unique(value[edges[k] : edges[k + 1]])
        sets.append(own)
        starts[k + 1] = starts[k] + len(own)
    return (np.concatenate(sets) if sets else value), starts


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``HASHES`` 32-bit MinHash values for each set; a set without shingles gets the largest value."""
    out = np.full((len(starts) - 1, HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    heads = starts[full]
    for k in range(HASHES):
        h = low * SEEDS[k] ^ high
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D) + (SEEDS[k] << np.uint32(1))
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        h ^= h >> np.uint32(15)
        out[full, k] = np.minimum.reduceat(h, heads)
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For m = 1 .. HASHES compared values: the fewest that must agree for a pair to be kept.

    With a uniform prior on the similarity, its posterior after k of m values agree is Beta(k + 1, m - k + 1);
    the pair is kept while the probability of at least ``threshold`` is not below ``tolerance``.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= threshold
    least = np.zeros(HASHES + 1, dtype=np.int32)
    for m in range(1, HASHES + 1):
        for k in range(m + 1):
            log = k * np.log(grid) + (m - k) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[above].sum() >= tolerance * density.sum():
                least[m] = k
                break
    return least


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "_text", 1 << 20):
        values, starts = shingles_of(rows.column("_text"), size)
        n = np.diff(starts)
        full = np.flatnonzero(n > 0)
        keys: list[bytes | None] = [None] * len(n)
        if len(full):
            # Two independent 64-bit sums name the set.
            sums = np.stack([np.add.reduceat(mix(values + np.uint64(c)), starts[full]) for c in (1, 0x5851F42D4C957F2D)], axis=1)
            for k, key in zip(full.tolist(), sums):
                keys[k] = key.tobytes()
        columns = [pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in signatures(values, starts)], pa.binary())]
        kept = [c for c in rows.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *columns], [*kept, "set", "n", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and band: a 64-bit bucket key of the band's number and values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = batch.slice(at, 2000)
            n = rows.num_rows
            signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32).reshape(n, BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
            for k in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, k])
            take = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *(rows.column(c).take(take) for c in ("class", "n"))], ["bucket", "class", "n"])


class _Unit:
    """The rows of one unit of work: classes with side 0 or 1; pairs are within side 0, or between the sides."""

    def __init__(self, classes, side, n, copies, signature):
        self.classes, self.side, self.n, self.copies = classes, side, n, copies
        self.signature = signature

    def pairs(self, bucket: int, crossing: bool, least: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
        """Pairs of row numbers left by size, first band and posterior, some at a time."""
        bands = self.signature.reshape(len(self.n), BANDS, ROWS)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(self.n), 1))
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
        key = key.view(np.int64)
        own = int(np.argmax(key[0] == bucket))
        left = np.flatnonzero(self.side == 0)
        right = np.flatnonzero(self.side == 1) if crossing else left
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
            if not crossing:
                i, j = i[i < j], j[i < j]
            fits = np.minimum(self.n[i], self.n[j]) >= threshold * np.maximum(self.n[i], self.n[j])
            i, j = i[fits], j[fits]
            for band in range(own):
                new = key[i, band] != key[j, band]
                i, j = i[new], j[new]
            agree, done = np.zeros(len(i), dtype=np.int32), 0
            while done < HASHES and len(i):
                end = min(done + STEP, HASHES)
                agree += (self.signature[i, done:end] == self.signature[j, done:end]).sum(axis=1, dtype=np.int32)
                done = end
                alive = agree >= least[done]
                i, j, agree = i[alive], j[alive], agree[alive]
            if len(i):
                yield np.stack([i, j])


def _unit(table: pa.Table) -> _Unit:
    raw = b"".join(table.column("signature").to_pylist())
    signature = np.frombuffer(raw, dtype=np.uint32).reshape(table.num_rows, HASHES)
    return _Unit(*(table.column(c).to_numpy() for c in ("class", "side", "n", "copies")), signature)


def _prune(batches: Iterator[pa.RecordBatch], least: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """(bucket, p, q, class, side) of the rows that have a pair left."""
    out: list[tuple] = []
    for table in units(batches):
        bucket, p, q = (table.column(c)[0].as_py() for c in ("bucket", "p", "q"))
        unit, left = _unit(table), np.zeros(table.num_rows, dtype=bool)
        for pair in unit.pairs(bucket, p != q, least, threshold):
            left[pair.ravel()] = True
        rows = np.flatnonzero(left)
        out += zip([bucket] * len(rows), [p] * len(rows), [q] * len(rows), unit.classes[rows].tolist(), unit.side[rows].tolist())
        if len(out) >= 5000:
            yield to_batch(out, UNIT_ROW)
            out = []
    if out:
        yield to_batch(out, UNIT_ROW)


UNIT_ROW = [("bucket", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("class", pa.int64()), ("side", pa.int32())]
LINK_ROW = [("class", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]


def _verify(batches: Iterator[pa.RecordBatch], size: int, least: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """(class, links, other): documents linked to a class in this unit, and an edge of the spanning forest."""
    out: list[tuple] = []
    for table in units(batches):
        bucket, p, q = (table.column(c)[0].as_py() for c in ("bucket", "p", "q"))
        # Repeated rows fetch the text of a class more than once.
        classes = table.column("class").to_numpy()
        table = table.take(np.sort(np.unique(classes, return_index=True)[1]))
        unit, sets = _unit(table), []
        for part in slices(iter(table.combine_chunks().to_batches()), "_text"):
            values, starts = shingles_of(part.column("_text"), size)
            sets += np.split(values, starts[1:-1])
        links, root = np.zeros(len(sets), dtype=np.int64), list(range(len(sets)))
        for pair in unit.pairs(bucket, p != q, least, threshold):
            for i, others in exact(pair, sets, threshold):
                links[i] += unit.copies[others].sum()
                links[others] += unit.copies[i]
                for j in others.tolist():
                    a, b = root_of(root, i), root_of(root, j)
                    root[max(a, b)] = min(a, b)
        for k in np.flatnonzero(links).tolist():
            out.append((int(unit.classes[k]), int(links[k]), int(unit.classes[root_of(root, k)])))
        if len(out) >= 5000:
            yield to_batch(out, LINK_ROW)
            out = []
    if out:
        yield to_batch(out, LINK_ROW)


def exact(pair: np.ndarray, sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each left side its partners with a Jaccard similarity of ``threshold`` or more.

    The shared shingles of many partners come from looking all theirs up in the left set at once.
    """
    order = np.argsort(pair[0], kind="stable")
    left, right = pair[0][order], pair[1][order]
    edges = [0, *(np.flatnonzero(np.diff(left)) + 1).tolist(), len(left)]
    for s, e in zip(edges[:-1], edges[1:]):
        own = sets[left[s]]
        for at in range(s, e, 256):
            partners = right[at : min(at + 256, e)]
            sizes = np.array([len(sets[k]) for k in partners.tolist()])
            theirs = np.concatenate([sets[k] for k in partners.tolist()])
            place = np.searchsorted(own, theirs)
            place[place == len(own)] = 0
            shared = np.add.reduceat((own[place] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
            # The margin is below any step of the quotient and above the rounding of the product.
            hit = shared >= threshold * (len(own) + sizes - shared) - 1e-7
            if hit.any():
                yield int(left[s]), partners[hit]


def similar_documents(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_copies, n_links, component_id, kept.

    Two documents are linked when their sets of ``shingle``-word shingles have a Jaccard similarity of
    ``threshold`` or more. class_id is the smallest id of the documents with the same set of shingles, n_copies
    their number, n_links the number of other documents linked directly (equal sets included), component_id
    the smallest id reachable over links, and kept is true for one row of each component.

    Words are runs of digits, letters A-Z in either case and characters beyond ASCII. A text with
    fewer than five words is one shingle. Null texts and texts without words link with nothing: class and
    component are their own id, n_copies is 1. Repeated rows are copies; of those with the kept id, one is
    kept. Rows with a null id take part as an id below all others, given back as null. Other columns of
    ``docs`` are not used.
    """
    judged = _judge(docs, doc, text, shingle, threshold, tolerance, block_shingles)
    return judged.select("doc_id", "class_id", "n_copies", "n_links", "component_id", "kept")


def _keyed(doc: str, text: str) -> tuple[Column, Column]:
    """A text is found again by the hash of it and its id as text, marked so that a null id is none of the others."""
    id_ = F.col(quoted(doc))
    return F.when(id_.isNull(), "null").otherwise(F.concat(F.lit("="), id_.cast("string"))).alias("_id"), F.xxhash64(F.col(quoted(text))).alias("_hash")


def _judge(docs: DataFrame, doc: str, text: str, shingle: int, threshold: float, tolerance: float, block_shingles: int) -> DataFrame:
    source = docs.select(F.col(quoted(doc)).alias("doc_id"), *_keyed(doc, text), F.monotonically_increasing_id().alias("row"), F.col(quoted(text)).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _id string, _hash long, row long, set binary, n long, signature binary"
    prints = materialize(source.mapInArrow(lambda b: _fingerprints(b, shingle), schema))
    # Of a set one row goes on, the smallest (doc_id, row); its row number names the class.
    first = F.min(F.struct("doc_id", "row"))
    named = prints.where("set is not null").groupBy("set").agg(first.alias("first"), F.count("*").alias("copies"))
    named = materialize(named.select("set", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class")))
    heads = prints.drop("set", "doc_id").withColumnRenamed("row", "class").join(named.select("class", "copies"), "class")
    heads = materialize(heads)

    least = least_matches(threshold, tolerance)
    banded = heads.select("class", "n", "signature").mapInArrow(_bands, "bucket long, class long, n long")
    crowds = banded.groupBy("bucket").agg(F.count("*").alias("many"), F.sum("n").alias("mass")).where("many > 1")
    blocks = F.greatest(F.ceil(F.col("mass") / F.lit(block_shingles)), F.ceil(F.col("many") / F.lit(BLOCK_CLASSES)))
    crowds = crowds.select("bucket", F.least(blocks, F.col("many")).cast("int").alias("blocks"))
    met = banded.select("bucket", "class").join(crowds, "bucket").withColumn("own", F.pmod(F.xxhash64("class", "bucket"), "blocks").cast("int"))
    units = met.select("bucket", "class", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side")
    units = units.select("bucket", "class", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), side)
    keys = ["bucket", "p", "q"]
    dealt = units.join(heads.select("class", "n", "copies", "signature"), "class").repartition(*keys).sortWithinPartitions(*keys, "side", "class")
    left = materialize(dealt.mapInArrow(lambda b: _prune(b, least, threshold), "bucket long, p int, q int, class long, side int"))

    needed = heads.join(left.select("class").distinct(), "class", "left_semi")
    texts = docs.select(*_keyed(doc, text), F.col(quoted(text)).alias("_text"))
    fetched = left.join(needed.join(texts, ["_id", "_hash"]).drop("_id", "_hash"), "class").repartition(*keys).sortWithinPartitions(*keys, "side", "class")
    links = materialize(fetched.mapInArrow(lambda b: _verify(b, shingle, least, threshold), "class long, links long, other long"))

    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    members = connected(links.where("class <> other").select(F.col("class").alias("a"), F.col("other").alias("b")))
    # The smallest document of a component, over its classes.
    ids = named.select(F.col("class").alias("node"), "class_id")
    heads_of = members.join(ids, "node").groupBy("component").agg(F.min(F.struct("class_id", "node")).alias("head"))
    placed = members.join(heads_of, "component").select(F.col("node").alias("class"), "head")
    component = F.when(F.col("head").isNull(), F.col("class_id")).otherwise(F.col("head.class_id")).alias("component_id")
    kept_row = F.when(F.col("head").isNull(), F.col("class")).otherwise(F.col("head.node")).alias("kept_row")
    summary = named.join(degree, "class", "left").join(placed, "class", "left")
    summary = materialize(summary.select("set", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), component, kept_row))
    # A hot set meets one row here: Spark splits it.
    rows = prints.select("doc_id", "row", "set", "_id", "_hash")
    n_links = (F.col("links") + F.col("copies") - 1).alias("n_links")
    kept = (F.col("row") == F.col("kept_row")).alias("kept")
    linked = rows.where("set is not null").join(summary, "set").select("doc_id", "class_id", F.col("copies").alias("n_copies"), n_links, "component_id", kept, "_id", "_hash")
    own = F.col("doc_id")
    alone = rows.where("set is null").select(own, own.alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"), "_id", "_hash")
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of linked documents, see ``similar_documents``.

    Rows without words are all kept, but of rows with equal id and text one stays. Columns pass through.
    """
    judged = _judge(docs, doc, text, shingle, threshold, TOLERANCE, BLOCK_SHINGLES)
    keyed = docs.select(packed(docs), *_keyed(doc, text))
    one = keyed.join(judged.where("kept").select("_id", "_hash"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return one.select(*unpacked(docs.columns))
