from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from webgauge.llm.lattice import SHORTEST, cells, design_for, meet, nearest_e8, similar_vectors, sketches, unit_vectors
from webgauge.llm.queries import op2_lattice_dedup
from webgauge.llm.units import pairs_between, whole_units

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("vector", T.StringType()), T.StructField("class", T.StringType())])


def brute(rows, threshold=0.95):
    usable = [v is not None and len(v) > 0 and all(e is not None and np.isfinite(e) for e in v) and any(v) for _, v in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], dtype=np.float64), np.array(rows[j][1], dtype=np.float64)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = [None] * len(rows)
    for start in range(len(rows)):
        group, todo = {start}, [start]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        ids = [rows[k][0] for k in group]
        smallest = None if None in ids else min(ids)
        out[start] = (rows[start][0], len(links[start]), smallest, rows[start][0] == smallest)
    return Counter(out)


def got(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_decoder_finds_the_nearest_point():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    point = nearest_e8(x)
    doubled = 2 * point
    assert (doubled == np.rint(doubled)).all() and ((doubled % 2 == 0).all(axis=1) | (doubled % 2 != 0).all(axis=1)).all() and (point.sum(axis=1) % 2 == 0).all()
    distance = ((x - point) ** 2).sum(axis=1)
    assert distance.max() <= 1 + 1e-9  # the covering radius
    for v in SHORTEST:
        assert (((x - point - v) ** 2).sum(axis=1) >= distance - 1e-9).all()


@pytest.mark.parametrize("rows", [100, 2000, 32000, 10**6])
def test_recall_at_the_threshold(rows):
    rng = np.random.default_rng(1)
    x = unit_vectors(rng.normal(size=(2000, 64)))
    noise = rng.normal(size=x.shape)
    noise = unit_vectors(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * noise
    design = design_for(rows)
    assert meet(cells(x, design), cells(y, design)).any(axis=1).mean() > 0.997
    assert np.bitwise_count(sketches(x) ^ sketches(y)).sum(axis=1).max() <= 58


def test_tables_grow_slowly():
    assert design_for(2000).tables < 12 and design_for(32000).tables < 18 and design_for(10**9).tables < 150
    assert design_for(0) == design_for(1) == design_for(1000)


def test_strangers_stay_as_many_with_more_rows():
    met = []
    for rows in (2000, 8000, 32000):
        x = unit_vectors(np.random.default_rng(rows).normal(size=(rows, 64)))
        keys = cells(x, design_for(rows))
        owned, members = np.unique(keys[:, :, 0], return_counts=True)
        probed = keys.ravel()
        at = np.searchsorted(owned, probed).clip(max=len(owned) - 1)
        met.append((members[at] * (owned[at] == probed)).sum() / rows - keys.shape[1])
    assert max(met) < 2 * min(met) and max(met) < 8, met


@pytest.mark.parametrize("block", [1000, 7])
def test_equals_brute_force_on_odd_rows(spark, block):
    rng = np.random.default_rng(2)
    vectors = []
    for spread, n in ((0.02, 25), (0.1, 20), (0.22, 15)):
        base = rng.normal(size=16)
        vectors += [base + spread * rng.normal(size=16) for _ in range(n)]
    vectors = [v.astype(np.float32).tolist() for v in vectors] + [v.astype(np.float32).tolist() for v in rng.normal(size=(60, 16))]
    vectors += [vectors[0], vectors[0], [2 * e for e in vectors[1]], [-e for e in vectors[2]], [0.0] * 16, [-0.0] * 16, None, [], [None] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1e30] * 16, [1e-30] * 16, [1.0] * 8, [1.0, 0.0] * 8]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(None, vectors[70]), (5, vectors[90])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(3)
    assert got(similar_vectors(df, block=block)) == brute(rows)


def test_units_come_whole_and_pairs_stay_in_them():
    rng = np.random.default_rng(4)
    bucket = np.sort(rng.integers(0, 40, 500))
    table = pa.table({"bucket": bucket, "p": bucket % 2, "q": np.zeros(500, dtype=np.int64), "row": np.arange(500)})
    for size, least in ((7, 1), (7, 30), (500, 30), (3, 10_000)):
        seen, pairs = [], []
        for part, unit in whole_units(iter([*table.to_batches(max_chunksize=size), table.to_batches()[0].slice(0, 0)]), least):
            rows = part.column("row").to_numpy()
            seen += rows.tolist()
            left, right = np.flatnonzero(rows % 3 != 0), np.flatnonzero(rows % 3 != 1)
            for i, j in pairs_between(unit, left, right, 50):
                pairs += zip(rows[i].tolist(), rows[j].tolist())
        assert seen == list(range(500))
        assert sorted(pairs) == [(i, j) for i in range(500) for j in range(500) if bucket[i] == bucket[j] and i % 3 != 0 and j % 3 != 1]
    assert list(whole_units(iter([]))) == [] and list(pairs_between(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 5)) == []


def test_lower_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        similar_vectors(spark.createDataFrame([], VECTORS), threshold=0.9)


def test_empty_table(spark):
    assert similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op2_lattice_dedup(spark, sf_dir)) == brute(rows)
