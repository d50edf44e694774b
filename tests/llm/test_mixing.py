from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from webgauge.llm.mixing import mix_sources
from webgauge.llm.oracle import ORACLE
from webgauge.llm.queries import op4_mix_sources

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("copy", T.StringType()), ("rate", T.StringType()))])
SF_DIR = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    result = con.execute(ORACLE["op4_mix_sources"])
    names = [d[0] for d in result.description]
    expected = sorted(result.fetchall(), key=repr)
    assert sorted(map(tuple, op4_mix_sources(spark, SF_DIR).select(*names).collect()), key=repr) == expected


def test_counts_are_poisson_and_weights_are_met(spark):
    rows = [(k, "t" * 9, "big" if k % 3 else "small") for k in range(6000)]
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    out = mix_sources(frame(spark, rows), weights).collect()
    n = Counter(r.doc_id for r in out)
    for name, rate in (("big", 0.375), ("small", 2.25)):
        counts = np.array([n[k] for k, _, s in rows if s == name])
        assert abs(counts.mean() - rate) < 5 * (rate / len(counts)) ** 0.5
        assert abs(counts.var() / rate - 1) < 0.15
    assert abs(sum(r.source == "small" for r in out) / len(out) - 0.75) < 0.03


def test_large_rates_are_drawn_in_parts(spark):
    rows = [(k, "t" * 9, "rare") for k in range(40)] + [(100 + k, "t" * 9, "rest") for k in range(4000)]
    weights = spark.createDataFrame([("rare", 9.0), ("rest", 1.0)], "source string, weight double")
    n = Counter(r.doc_id for r in mix_sources(frame(spark, rows), weights).collect())
    counts, rate = np.array([n[k] for k in range(40)]), 0.9 * 4040 / 40
    assert rate > 64 and abs(counts.mean() - rate) < 5 * (rate / 40) ** 0.5


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "L" * 300_000, "a"), (3, None, "b"), (None, "x", "none")]
    out = mix_sources(frame(spark, rows), epochs=3.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "rate"]
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[(1, "")] % 2 == 0 and set(got) <= {(d, t) for d, t, _ in rows}
    assert set(mix_sources(frame(spark, rows), details=True).columns) == {"doc_id", "text", "source", "rate", "n_copies", "copy", "place"}
    some = spark.createDataFrame([("a", 1.0), ("absent", 1.0), (None, 1.0)], "source string, weight double")
    assert {r.source for r in mix_sources(frame(spark, rows), some, epochs=9.0).collect()} <= {"a", None}


def test_empty_table_and_order(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    parts = mix_sources(frame(spark, [(k, "x", "s") for k in range(300)]), details=True).select("place").rdd.glom().collect()
    assert all([r.place for r in p] == sorted(r.place for r in p) for p in parts)
