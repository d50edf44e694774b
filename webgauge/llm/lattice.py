"""Near-duplicate vectors by E8 lattice hashing.

1. Equal vectors form one class, which goes on as one row.
2. In each of several tables a vector is projected at random to blocks of eight numbers; each block is
   decoded to the nearest point of the lattice E8, and the points together are the cell of the vector. It
   also probes the ``PROBES`` neighbouring cells that are nearest to it.
3. The vectors of a cell and those that probe it meet in a unit of work; a crowded cell is dealt into blocks and
   each pair of blocks is a unit. Pairs whose bit sketches differ too much are left out at once.
4. Rows with a pair left fetch their vectors, and those pairs are verified by cosine in double precision. A pair
   that meets in several units counts in the first one only.

The more rows, the narrower the cells, so that a vector meets about ``STRANGERS`` unrelated ones at any number of rows;
and the narrower the cells, the more tables, so that a pair at the threshold meets with a probability of ``RECALL`` (see
``design_for``; closer pairs meet more often). That takes 9 tables for 2,000 rows, about 14 for 32,000 and 100 for 10^9.
Vectors that are no random directions, but lie in clouds below the threshold, meet more often. A unit gives back link
counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import mix
from webgauge.llm.components import connected
from webgauge.llm.units import pairs_between, root_of, to_batch, units, whole_units
from webgauge.session import materialize

THRESHOLD = 0.95
PROBES = 4
#: Unrelated vectors that a vector is to meet, and the chance that a pair at the threshold meets.
STRANGERS, RECALL = 4.0, 0.9995
#: Cells narrower than this take one more block of eight numbers instead.
NARROWEST = 1.5
#: Bits of a sketch, and the most that may differ: at a cosine of 0.95 about 26 do, with a deviation of 5.
BITS, MOST_BITS = 256, 58
#: Most members of either side of a unit, on average.
BLOCK = 1000
PAIRS_AT_ONCE = 100_000


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of +-1, and halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum (the lattice D8)."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    rest = x[odd] - point[odd]
    worst = np.argmax(np.abs(rest), axis=1)
    point[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by one half in every place."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def _keys(points: np.ndarray, table: int, dimension: int) -> np.ndarray:
    """A 64-bit key of the cells with these lattice points (rows of multiples of one half)."""
    key = np.full(points.shape[:-1], table * 1_000_003 + dimension, dtype=np.uint64)
    doubled = (2 * points).astype(np.int64).view(np.uint64)
    for k in range(points.shape[-1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + doubled[..., k])
    return key.view(np.int64)


@dataclass(frozen=True)
class Design:
    """Tables, blocks of eight numbers in each, and the width of a cell as a share of a unit vector's projection."""

    tables: int
    blocks: int
    width: float


def around(y: np.ndarray, table: int, dimension: int) -> np.ndarray:
    """keys[row, 0] is the cell of a projected vector, keys[row, 1:] are the cells it probes."""
    blocks, rows = y.shape[1] // 8, np.arange(len(y))
    point = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
    # A neighbour c + v is nearer the larger the product of v with what the decoder left over.
    gain = np.concatenate([(y - point)[:, 8 * b : 8 * b + 8] @ SHORTEST.T for b in range(blocks)], axis=1)
    best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
    points = np.repeat(point[:, None, :], PROBES + 1, axis=1).reshape(len(y), PROBES + 1, blocks, 8)
    for k in range(PROBES):
        points[rows, k + 1, best[:, k] // len(SHORTEST)] += SHORTEST[best[:, k] % len(SHORTEST)]
    return _keys(points.reshape(len(y), PROBES + 1, 8 * blocks), table, dimension)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of two vectors is in or probes the cell of the other, by row and by table if there are any."""
    return (a[..., :1] == b).any(axis=-1) | (b[..., :1] == a).any(axis=-1)


def design_for(rows: int, threshold: float = THRESHOLD) -> Design:
    """The design for so many rows.

    Two random directions meet in a table with a chance of about (0.0085 (width / 2) ** 6) ** blocks (measured between
    widths of 1.6 and 2.5; the test counts the pairs). The chance of a pair at the threshold is measured here on 4,000
    pairs: projections of two unit vectors are normal numbers that correlate by their cosine, whatever the dimension.
    """
    wanted = STRANGERS / (max(rows, 1000) * 16)
    blocks, width = 2, 0.0
    while (width := 2 * (wanted ** (1 / blocks) / 0.0085) ** (1 / 6)) < NARROWEST:
        blocks += 1
    rng = np.random.default_rng(0)
    a, other = rng.normal(size=(2, 4000, 8 * blocks))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * other
    shift = rng.random(8 * blocks)
    chance = min(float(meet(around(a / width + shift, 0, 0), around(b / width + shift, 0, 0)).mean()), 0.999)
    return Design(math.ceil(math.log(1 - RECALL) / math.log(1 - chance)), blocks, width)


def cells(x: np.ndarray, design: Design, seed: int = 0) -> np.ndarray:
    """keys[row, table, 0] is the cell of a unit vector, keys[row, table, 1:] are the cells it probes."""
    n, d = x.shape
    out = np.empty((n, design.tables, PROBES + 1), dtype=np.int64)
    for t in range(design.tables):
        rng = np.random.default_rng([seed, d, t])
        out[:, t] = around(x @ (rng.normal(size=(d, 8 * design.blocks)) / design.width) + rng.random(8 * design.blocks), t, d)
    return out


def sketches(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Signs of ``BITS`` random projections, packed."""
    rng = np.random.default_rng([seed, x.shape[1], 1_000])
    return np.packbits(x @ rng.normal(size=(x.shape[1], BITS)) > 0, axis=1)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each usable vector in its own precision; null for the others."""
    for batch in batches:
        column = batch.column("_v")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        x = column.flatten().to_numpy(zero_copy_only=False) + column.type.value_type.to_pandas_dtype()(0)  # no negative zeros; null is nan
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        starts, odd, used = np.concatenate([[0], ends[:-1]]), upto(~np.isfinite(x)), upto(x != 0)
        usable = (odd[ends] == odd[starts]) & (used[ends] > used[starts])
        raw, size = x.tobytes(), x.itemsize
        out = [raw[s * size : e * size] if u else None for s, e, u in zip(starts.tolist(), ends.tolist(), usable.tolist())]
        kept = [c for c in batch.schema.names if c != "_v"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "vector"])


def _matrix(raw: list[bytes], precision: str) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    return unit_vectors(np.frombuffer(b"".join(raw), dtype=precision).reshape(len(raw), -1).astype(np.float64))


def _hash(batches: Iterator[pa.RecordBatch], design: Design, precision: str, seed: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            raw = batch.column("vector").to_pylist()
            length = np.array([len(r) for r in raw])
            keys, bits = np.empty((len(raw), design.tables, PROBES + 1), dtype=np.int64), np.empty((len(raw), BITS // 8), dtype=np.uint8)
            for n in np.unique(length).tolist():  # vectors of different lengths never meet
                mine = np.flatnonzero(length == n)
                x = _matrix([raw[k] for k in mine.tolist()], precision)
                keys[mine], bits[mine] = cells(x, design, seed), sketches(x, seed)
            columns = [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "keys", "bits"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, class, owner, bits): a row for each cell that a class is in or probes."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1)
            take = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            owner = np.tile(np.arange(keys.shape[1]) % (PROBES + 1) == 0, batch.num_rows)
            columns = [pa.array(keys.ravel()), batch.column("class").take(take), pa.array(owner)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "class", "owner"])


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the side of the owners (0) and on that of the others (1); 2 is both."""
    side = table.column("side").to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that have a pair with similar sketches."""
    for table, unit in whole_units(batches):
        owners, probers = _sides(table)
        classes = table.column("class").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)
        left = np.zeros(table.num_rows, dtype=bool)
        for i, j in pairs_between(unit, owners, probers, PAIRS_AT_ONCE):
            near = (np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= MOST_BITS) & (classes[i] != classes[j])
            left[i[near]] = left[j[near]] = True
        yield from table.select([c for c, _ in UNIT_ROW]).filter(pa.array(left)).to_batches()


UNIT_ROW = [("bucket", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("class", pa.int64()), ("side", pa.int32())]
LINK_ROW = [("class", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]


def first_meeting(bucket: int, keys: np.ndarray, classes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the unit of this cell, with i in it and j probing it, is the first in which a pair meets.

    Meetings stand in order of their table, and within it the cell of the smaller class comes first.
    """
    table = int(np.argmax((keys[i[0], :, 0] == bucket)))
    small, large = np.where(classes[i] < classes[j], i, j), np.where(classes[i] < classes[j], j, i)
    first = np.ones(len(i), dtype=bool)
    for t in range(table):
        first &= ~(keys[small, t, :1] == keys[large, t]).any(axis=1)
        first &= ~(keys[large, t, :1] == keys[small, t]).any(axis=1)
    return first & ((classes[i] < classes[j]) | ~(keys[small, table, :1] == keys[large, table]).any(axis=1))


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, precision: str) -> Iterator[pa.RecordBatch]:
    """(class, links, other): vectors linked to a class in this unit, and an edge of the spanning forest."""
    out: list[tuple] = []
    for table in units(batches):
        bucket = table.column("bucket")[0].as_py()
        owners, probers = _sides(table)
        if not len(owners) or not len(probers):
            continue
        classes, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.int64).reshape(table.num_rows, -1, PROBES + 1)
        x = _matrix(table.column("vector").to_pylist(), precision)
        name, node = np.unique(classes, return_inverse=True)
        links, root = np.zeros(len(name), dtype=np.int64), list(range(len(name)))
        step = max(1, PAIRS_AT_ONCE // len(probers))
        for at in range(0, len(owners), step):
            some = owners[at : at + step]
            i, j = np.nonzero((x[some] @ x[probers].T >= threshold) & (classes[some][:, None] != classes[probers][None, :]))
            i, j = some[i], probers[j]
            if not len(i):
                continue
            first = first_meeting(bucket, keys, classes, i, j)
            i, j = i[first], j[first]
            np.add.at(links, node[i], copies[j])
            np.add.at(links, node[j], copies[i])
            for a, b in zip(node[i].tolist(), node[j].tolist()):
                a, b = root_of(root, a), root_of(root, b)
                root[max(a, b)] = min(a, b)
        for k in np.flatnonzero(links).tolist():
            out.append((int(name[k]), int(links[k]), int(name[root_of(root, k)])))
        if len(out) >= 5000:
            yield to_batch(out, LINK_ROW)
            out = []
    if out:
        yield to_batch(out, LINK_ROW)


def similar_vectors(vectors: DataFrame, *, vec: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept, n_copies.

    n_links is the number of other vectors found with a cosine of ``threshold`` or more (equal vectors
    included), component_id the smallest id reachable over links, kept whether that is the vector's own id.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their
    own component. Vectors of different lengths never link. Repeated rows are equal vectors. A null id counts as
    smaller than all others and is given back as null; a row with one is kept only if it is its own component.
    Other columns are not used. ``threshold`` may be raised but not lowered: the sketches are made for 0.95.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the tables and sketches find links from a cosine of {THRESHOLD} on, not {threshold}")
    single = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), T.FloatType)
    precision = "float32" if single else "float64"
    numbers = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    source = vectors.select(F.col(vec).alias("vec_id"), F.monotonically_increasing_id().alias("row"), numbers.alias("_v"))
    kind = source.schema["vec_id"].dataType.simpleString()
    coded = source.mapInArrow(_vectors, f"vec_id {kind}, row long, vector binary")
    # Equal vectors are told by a SHA-256 of their bytes, so that only one of them travels.
    stored = materialize(coded.withColumn("code", F.unhex(F.sha2("vector", 256))))
    design = design_for(stored.count(), threshold)
    named = stored.where("vector is not null").groupBy("code").agg(F.min(F.struct("vec_id", "row")).alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    named = named.select(F.col("first.row").alias("class"), F.col("first.vec_id").alias("class_id"), "copies", "code", "vector")
    hashed = f"class long, class_id {kind}, copies long, code binary, vector binary, keys binary, bits binary"
    heads = materialize(named.mapInArrow(lambda b: _hash(b, design, precision, seed), hashed))

    met = heads.select("class", "keys").mapInArrow(_meetings, "bucket long, class long, owner boolean")
    owners = F.count_if("owner")
    crowds = met.groupBy("bucket").agg(owners.alias("owners"), (F.count("*") - owners).alias("probers")).where("owners > 0 and owners + probers > 1")
    split = lambda n: F.ceil(n / F.lit(block)).cast("int")
    crowds = crowds.select("bucket", split(F.col("owners")).alias("ps"), split(F.col("owners") + F.col("probers")).alias("qs"))
    own = lambda n: F.pmod(F.xxhash64("class", "bucket"), F.col(n)).cast("int")
    met = met.join(crowds, "bucket")
    # A class in a cell stands on both sides: as its owner, and among those that look for others there.
    as_owner = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: F.struct(own("ps").alias("p"), q.alias("q"), F.lit(0).alias("side")))
    as_prober = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: F.struct(p.alias("p"), own("qs").alias("q"), F.lit(1).alias("side")))
    as_both = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("side")))
    stands = F.when(F.col("owner") & (F.col("ps") == 1) & (F.col("qs") == 1), as_both).when(F.col("owner"), F.concat(as_owner, as_prober)).otherwise(as_prober)
    placed = met.select("bucket", "class", F.explode(stands).alias("u")).select("bucket", "u.p", "u.q", "class", "u.side")
    keys = ["bucket", "p", "q"]
    dealt = placed.join(heads.select("class", "bits"), "class").repartition(*keys).sortWithinPartitions(*keys)
    left = materialize(dealt.mapInArrow(_prune, "bucket long, p int, q int, class long, side int"))
    fetched = left.join(heads.select("class", "copies", "vector", "keys"), "class").repartition(*keys).sortWithinPartitions(*keys)
    links = materialize(fetched.mapInArrow(lambda b: _verify(b, threshold, precision), "class long, links long, other long"))

    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    members = connected(links.where("class <> other").select(F.col("class").alias("a"), F.col("other").alias("b")))
    ids = heads.select(F.col("class").alias("node"), "class_id")
    smallest = members.join(ids, "node").groupBy("component").agg(F.min(F.struct("class_id")).alias("head"))
    component = members.join(smallest, "component").select(F.col("node").alias("class"), "head")
    own_id = F.when(F.col("head").isNull(), F.col("class_id")).otherwise(F.col("head.class_id")).alias("component_id")
    summary = heads.select("class", "class_id", "copies", "code").join(degree, "class", "left").join(component, "class", "left")
    summary = materialize(summary.select("code", "copies", F.coalesce("links", F.lit(0)).alias("links"), own_id))
    # A hot vector meets one row here: Spark splits it.
    linked = stored.where("vector is not null").join(summary, "code").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", "copies")
    alone = stored.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    all_ = linked.unionByName(alone)
    return all_.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("copies").alias("n_copies"))
