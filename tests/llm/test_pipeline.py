"""Every stage of the pipeline against a brute-force version, each on the input that it really gets."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from test_decontaminate import brute as contaminated
from test_jaccard import brute as linked
from test_jaccard import shingles

import corpus_pipeline
from webgauge.llm.oracle import ORACLE
from webgauge.llm.quality import fit, statistics
from webgauge.session import materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_DIR)))
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(df.columns == stages[0].columns for df in stages[1:5])
    assert stages[5].columns == [*stages[0].columns, "shard", "slot"]


def test_quality(spark, stages):
    docs = rows(stages[0], "doc_id", "text")
    labels = dict(rows(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id", "quality"))
    x = statistics(pa.array([t for _, t in docs]))
    learn = np.array([d in labels and zlib.crc32(str(d).encode()) % 3 != 1 for d, _ in docs])
    y = np.array([labels.get(d, -1) for d, _ in docs])
    model = fit([(float((learn & (y == c)).sum()), x[learn & (y == c)].sum(axis=0), x[learn & (y == c)].T @ x[learn & (y == c)]) for c in (0, 1)])
    kept = {d for (d, _), s in zip(docs, model.scores(x)) if s >= 0.5}
    assert {d for (d,) in rows(stages[1], "doc_id")} == kept


def test_near_duplicates(stages):
    docs = rows(stages[1], "doc_id", "text")
    assert all(shingles(t) for _, t in docs)
    assert Counter(d for (d,) in rows(stages[2], "doc_id")) == Counter({r[4]: 1 for r in linked(docs)})


def test_decontamination(spark, stages):
    bench = rows(spark.read.parquet(f"{SF_DIR}/benchmark.parquet"), "item_id", "text")
    clean = {r[0] for r in contaminated(rows(stages[2], "doc_id", "text"), bench) if not r[5]}
    assert {d for (d,) in rows(stages[3], "doc_id")} == clean


def test_mixing(stages):
    con = duckdb.connect()
    documents = stages[3].toArrow()
    con.register("documents", documents)
    columns = stages[3].columns
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op4_mix_sources']})").fetchall()
    assert Counter(rows(stages[4], *columns)) == Counter(expected)


def test_sharding(stages):
    columns = stages[4].columns
    assert Counter(rows(stages[5], *columns)) == Counter(rows(stages[4], *columns))
    slots = {}
    for shard, slot in rows(stages[5], "shard", "slot"):
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(corpus_pipeline.SHARDS)]
    assert max(sizes) - min(sizes) <= 1


def test_odd_rows_and_empty_tables_go_through(spark, tmp_path):
    docs = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
    for name, data in (("full", [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, "a", 1), (3, "w " * 50_000, "en", "b", 9), (3, "w " * 50_000, "en", "b", 9)]), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(2, 1)] if data else [], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
        assert data or out.count() == 0
