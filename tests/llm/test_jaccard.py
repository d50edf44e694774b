import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from webgauge.llm.components import connected
from webgauge.llm.jaccard import HASHES, drop_near_duplicates, least_matches, similar_documents
from webgauge.llm.queries import op10_jaccard_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("class", T.StringType()), ("n", T.StringType()))])


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs, threshold=0.8):
    """Every pair of rows; ids may repeat, so rows are told apart by their number."""
    sets = [shingles(t) for _, t in docs]
    links = [set() for _ in docs]
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                    links[i].add(j)
                    links[j].add(i)
    key = lambda k: (docs[k][0] is not None, docs[k][0] or 0)
    out, seen = [None] * len(docs), set()
    for start in sorted(range(len(docs)), key=key):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        for k in group:
            same = [j for j in range(len(docs)) if sets[j] == sets[k]] if sets[k] else [k]
            out[k] = (docs[k][0], docs[min(same, key=key)][0], len(same), len(links[k]), docs[min(group, key=key)][0])
    return Counter(out)


def components_of(docs):
    """One row number of each component."""
    ids = [(k, t) for k, (_, t) in enumerate(docs)]
    return {r[4] for r in brute(ids)}


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_copies, r.n_links, r.component_id) for r in df.collect())


def varied(rng, n=30, length=120, edits=3):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("block_shingles", [200_000, 500])
def test_equals_brute_force_on_odd_rows(spark, block_shingles):
    rng = random.Random(7)
    texts = [*varied(rng), *varied(rng, n=10, length=400, edits=20), *varied(rng, n=5, length=8, edits=1)]
    texts += ["same TEXT here", "Same text, here!", "same", None, "", "...", None, "é É ü é É", "one two three four five six", "L " + "W" * 200_000]
    docs = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, texts[1]), (None, None), (5, "same id other text")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS).repartition(3)
    out = similar_documents(df, block_shingles=block_shingles)
    assert got(out) == brute(docs)
    kept = [r for r in out.collect() if r.kept]
    assert len(kept) == len(components_of(docs))


def test_drop_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    docs = [(k, t) for k, t in enumerate([*varied(rng, n=12), *varied(rng, n=12)])] + [(50, "alone in its group of words"), (51, ""), (0, None), (0, None)]
    df = spark.createDataFrame([(*d, "c", "d") for d in docs] + [(*docs[0], "c", "d")], DOCS)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    first = {r[4] for r in brute([d for d in docs if shingles(d[1])])}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows if shingles(r.text)) == sorted(first)
    assert sorted(r.doc_id for r in rows if not shingles(r.text)) == [0, 51]


def test_pruning_rule():
    least = least_matches(0.8, 1e-6)
    assert (np.diff(least[1:]) >= 0).all() and least[HASHES] < 0.8 * HASHES
    # A pair at the threshold survives all comparisons almost surely.
    rng, lost = np.random.default_rng(0), 0
    for _ in range(4000):
        agree = np.cumsum(rng.random(HASHES) < 0.8)
        lost += any(agree[m - 1] < least[m] for m in range(12, HASHES + 1, 12))
    assert lost <= 4


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 150)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 140), 100), 200: 150, 150: 150}
    assert found == expected
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert similar_documents(df).count() == 0 and drop_near_duplicates(df).count() == 0


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op10_jaccard_join(spark, sf_dir)) == brute(docs)
