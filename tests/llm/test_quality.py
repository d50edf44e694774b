import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from webgauge.llm.quality import FEATURES, PRIOR_UNITS, PSEUDO_ROWS, TEMPERATURE, TO_DIAGONAL, TO_POOLED, class_sums, fit, keep_good, score_documents, statistics
from webgauge.llm.queries import op1_quality_discriminant

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("_stats", T.StringType()), ("score", T.StringType()))])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])
SF_DIR = "/root/testdata/sf0.01"


def test_statistics_of_a_small_text():
    text = "Aa bb bb 12!\n\nAa é"
    x = dict(zip(FEATURES, statistics(pa.array(["x", text, None, "", text]))[1]))
    share = lambda name, part, whole: math.log((part + PRIOR_UNITS * FEATURES[name]) / (whole + PRIOR_UNITS))
    size, words = len(text.encode()), 6
    expected = {
        "length": math.log1p(size), "words": math.log1p(words), "word_length": share("word_length", 12, words), "upper": share("upper", 2, 8), "digit": share("digit", 2, size),
        "space": share("space", 4, size), "line": share("line", 2, words), "stop": share("stop", 0, words), "symbol": share("symbol", 1, words), "top_symbol": share("top_symbol", 1, words),
        "long_words": share("long_words", 0, words), "doubled_words": share("doubled_words", 1, words), "distinct_words": share("distinct_words", 4, words), "distinct_lines": share("distinct_lines", 2, 2),
    }
    assert x.keys() == expected.keys() and all(abs(x[k] - v) < 1e-12 for k, v in expected.items())
    assert np.array_equal(statistics(pa.array([None, "", text]))[[0, 2]], np.stack([statistics(pa.array([""]))[0], statistics(pa.array([text]))[0]]))


def test_scores_equal_gaussian_densities():
    rng = np.random.default_rng(1)
    data = [rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + shift for n, shift in ((40, 0.0), (200, 1.0))]
    model = fit([(float(len(x)), x.sum(axis=0), x.T @ x) for x in data])
    x = rng.normal(size=(50, 3))
    log = []
    for mean, whiten, group in zip(model.means, model.whiten, data):
        covariance = np.linalg.inv(whiten.T @ whiten)
        d = x - mean
        log.append(math.log(len(group) / 240) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariance), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp((log[0] - log[1]) / model.temperature)))


def test_sums_over_all_rows(spark):
    d = len(FEATURES)
    x = np.random.default_rng(2).normal(size=(30, d))
    rows = [(k % 2, r.tolist()) for k, r in enumerate(x)] + [(7, [9.0] * d)]
    sums = class_sums(spark.createDataFrame(rows, "y int, x array<double>"), "y", "x")
    for c in (0, 1):
        assert sums[c][0] == 15 and np.allclose(sums[c][1], x[c::2].sum(axis=0)) and np.allclose(sums[c][2], x[c::2].T @ x[c::2])


def test_held_out_accuracy_and_shape(spark):
    scored = op1_quality_discriminant(spark, SF_DIR).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(scored) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    test = [r for r in scored if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.97


def plain_statistics(text):
    """The statistics of one text, byte by byte."""
    raw = (text or "").encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    lines = [line for line in raw.split(b"\n") if line]
    stops, blank = set(b".,;:'\"?()-"), set(b" \t\n\r")
    alone = Counter(b for b in raw if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in stops or b in blank))
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    part_of = {
        "word_length": (sum(map(len, words)), len(words)), "upper": (upper, upper + lower), "digit": (sum(48 <= b <= 57 for b in raw), len(raw)),
        "space": (sum(b in b" \t" for b in raw), len(raw)), "line": (sum(b in b"\r\n" for b in raw), len(words)), "stop": (sum(b in stops for b in raw), len(words)),
        "symbol": (sum(alone.values()), len(words)), "top_symbol": (max(alone.values(), default=0), len(words)), "long_words": (sum(len(w) > 20 for w in words), len(words)),
        "doubled_words": (sum(a == b for a, b in zip(low, low[1:])), len(words)), "distinct_words": (len(set(low)), len(words)), "distinct_lines": (len(set(lines)), len(lines)),
    }
    shares = {name: math.log((a + PRIOR_UNITS * FEATURES[name]) / (b + PRIOR_UNITS)) for name, (a, b) in part_of.items()}
    return [{"length": math.log1p(len(raw)), "words": math.log1p(len(words)), **shares}[name] for name in FEATURES]


def test_query_equals_brute_force(spark):
    """Every row of the table: statistics byte by byte, class covariances and densities without factors."""
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "labels"))
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in docs}
    train = [(x[r.doc_id], r.quality) for r in labels if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    groups = [np.array([v for v, y in train if y == c]) for c in (0, 1)]
    scatter = [(g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in groups]
    pooled, d = sum(scatter) / len(train), len(FEATURES)
    floor = 1e-3 + 1e-3 * np.trace(pooled) / d
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + floor * np.eye(d)

    def density(v, c):
        n = len(groups[c])
        weight = (TO_POOLED * n + PSEUDO_ROWS) / (n + PSEUDO_ROWS)
        covariance, off = (1 - weight) * scatter[c] / n + weight * pooled, v - groups[c].mean(axis=0)
        return math.log(n / len(train)) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * off @ np.linalg.solve(covariance, off)

    found = {r.doc_id: r for r in op1_quality_discriminant(spark, sf_dir).collect()}
    assert found.keys() == x.keys() and len(docs) == len(x)
    for k, v in x.items():
        score = 1 / (1 + math.exp(min(60.0, max(-60.0, (density(v, 0) - density(v, 1)) / TEMPERATURE))))
        assert abs(found[k].score - score) < 1e-6 and found[k].predicted == (found[k].score >= 0.5), (k, found[k].score, score)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    assert sorted(map(tuple, score_documents(docs, labels).collect())) == sorted(map(tuple, score_documents(docs, turned).collect()))


def test_odd_rows(spark):
    good, bad = "The same quiet words go on and on here, as they do. ", "$$$ !!! BUY %%% NOW ### "
    rows = [(k, good * (1 + k % 7) if k % 2 else bad * (1 + k % 5)) for k in range(60)]
    rows += [(100, None), (101, ""), (None, good), (7, good), (7, good), (102, good * 20_000)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    labels = spark.createDataFrame([(k, k % 2, "clash") for k in range(60)] + [(61, None, ""), (None, 1, ""), (3, 5, "")], LABELS)
    out = score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {(r.doc_id): r for r in out}
    assert by[1].predicted == 1 and by[2].predicted == 0 and by[None].held_out
    assert by[100].score == by[101].score
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, "x", "", "")], DOCS)
    assert score_documents(docs, labels).count() == 0
    assert score_documents(one, labels).first().score == 0.5
    assert keep_good(one, labels).count() == 1
