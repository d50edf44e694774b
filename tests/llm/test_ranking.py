import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from webgauge.llm import ranking
from webgauge.llm.oracle import ORACLE
from webgauge.llm.queries import op12_lexical_search

SF_DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("item", T.StringType()), ("score", T.StringType()), ("rank", T.StringType()))])
ITEMS = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.StringType()), ("text", T.StringType()), ("doc_id", T.StringType()))])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, df = sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    n = len(counts)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    result = con.execute(ORACLE["op12_lexical_search"])
    names = [d[0] for d in result.description]
    out = op12_lexical_search(spark, SF_DIR)
    assert set(out.columns) == set(names)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("block_chars", [4_000_000, 30])
@pytest.mark.parametrize("coordinates", [1024, 3])
def test_equals_brute_force(spark, monkeypatch, block_chars, coordinates):
    monkeypatch.setattr(ranking, "COORDINATES", coordinates)
    rng = np.random.default_rng(0)
    word = lambda: f"w{int(rng.zipf(1.3)) % 300}"
    docs = [(k, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for k in range(300)]
    docs += [(1000 + k, "w1 w2 W3, w4-w5") for k in range(40)] + [(None, "w1 w2 w3 w4 w5"), (None, None), (7, ""), (8, " . "), (9, "É été Été ÀB àB"), (10, "w9 " * 200_000)]
    items = [(f"i{k}", " ".join(word() for _ in range(8))) for k in range(6)] + [("same", "w1 w1 W2 w3"), ("same", "été"), (None, "w9"), ("none", None), ("void", ""), ("dots", "..."), ("new", "unheard")]
    df = spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    assert got(ranking.rank_documents(df, asked, block_chars=block_chars)) == brute(docs, items)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    row, term = np.repeat(np.arange(50), 40), rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    impact = rng.integers(1, 10**6, 2000)
    folded = ranking.sketch(50, row, term, impact)
    assert (folded[(term % np.uint64(ranking.COORDINATES)).astype(int), row] >= impact).all()
    assert folded.sum() <= impact.sum()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([("a", "w1", "c")], ITEMS)
    full = spark.createDataFrame([(1, "w1", "c", "c", "c")], DOCS)
    for d, i in ((docs, items), (docs, some), (full, items)):
        out = ranking.rank_documents(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
