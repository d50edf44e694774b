import zlib
from collections import Counter
from math import comb
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import types as T

from webgauge.llm.queries import op8_sharding
from webgauge.llm.sharding import GROUP, Plan, _hypergeometric, _targets, communication_matrix, shard_rows, shard_sizes

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("slot", T.StringType())])


def test_matrix_has_both_margins_and_the_right_means():
    counts, sizes = [5, 0, 17, 8], shard_sizes(30, 4)
    total = np.zeros((4, 4))
    for seed in range(3000):
        matrix = communication_matrix(counts, sizes, seed)
        assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == sizes.tolist() and (matrix >= 0).all()
        total += matrix
    assert np.abs(total / 3000 - np.outer(counts, sizes) / 30).max() < 0.1


def test_matrix_of_very_many_rows():
    counts = [3 * 10**9, 2 * 10**9, 7]
    sizes = shard_sizes(sum(counts), 3)
    matrix = communication_matrix(counts, sizes, 1)
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == sizes.tolist() and (matrix >= 0).all()


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 6), (2, 30, 20), (9, 3, 11)])
def test_small_draws_follow_the_exact_law(good, bad, draws):
    rng, runs = np.random.default_rng(0), 20_000
    seen = Counter(_hypergeometric(rng, good, bad, draws) for _ in range(runs))
    exact = {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(min(good, draws) + 1) if draws - k <= bad}
    assert set(seen) <= set(exact)
    likely = {k: p for k, p in exact.items() if p * runs >= 5}
    assert sum((seen[k] - p * runs) ** 2 / (p * runs) for k, p in likely.items()) < 3 * len(likely) + 15


def test_draws_from_three_billion_rows_follow_the_law():
    good, bad, draws, runs, bins = 10**9, 2 * 10**9, 15 * 10**8, 4000, 40
    total = good + bad
    # The law is normal here; half the rows are drawn, so its variance is half that of a binomial.
    law = NormalDist(draws * good / total, (draws * (good / total) * (bad / total) * (total - draws) / (total - 1)) ** 0.5)
    rng = np.random.default_rng(0)
    seen = Counter(int(law.cdf(_hypergeometric(rng, good, bad, draws)) * bins) for _ in range(runs))
    assert sum((seen[b] - runs / bins) ** 2 / (runs / bins) for b in range(bins)) < 90  # 39 degrees of freedom: p about 1e-5


def test_groups_of_partitions_keep_both_margins():
    counts = {p * 3: p % 7 for p in range(2 * GROUP + 5)}
    plan = Plan.draw(counts, 4, 9)
    rows = np.array([plan.row(p) for p in counts])
    assert rows.sum(axis=1).tolist() == list(counts.values())
    assert rows.sum(axis=0).tolist() == shard_sizes(sum(counts.values()), 4).tolist()


@pytest.mark.parametrize("n,shards", [(0, 3), (1, 3), (2, 5), (200, 7)])
def test_exact_sizes_gapless_slots_all_rows(spark, n, shards):
    odd = [(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "L" * 300_000, "x", "y")]
    data = (odd * n)[:n]
    out = shard_rows(spark.createDataFrame(data, DOCS).repartition(5), shards)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d, t) for d, t, _, _ in data)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert [len(slots.get(s, [])) for s in range(shards)] == shard_sizes(n, shards).tolist()


def test_slots_are_uniform():
    counts, sizes, pieces, runs = [5, 4, 3], shard_sizes(12, 2), 4, 3000
    place = np.zeros((12, 12))
    for seed in range(runs):
        matrix = communication_matrix(counts, sizes, seed)
        drawn = [_targets(p, matrix[p], pieces, seed) for p in range(3)]
        shard, piece, key = (np.concatenate(x) for x in zip(*drawn))
        place[np.lexsort((key, piece, shard)), np.arange(12)] += 1
    expected = runs / 12
    assert ((place - expected) ** 2 / expected).sum() < 190  # 121 degrees of freedom: p about 5e-5


def test_repeatable(spark):
    df = spark.range(12).repartition(3)
    again = [sorted(map(tuple, shard_rows(df, 2, seed=3).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = op8_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.grown_shard is None for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
