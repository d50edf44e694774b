import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from webgauge.llm.queries import op5_toxicity
from webgauge.llm.toxicity import FEATURES, GRADES, LEAST_TEXTS, LEAST_Z, PREFIXES, SAMPLE, Features, fit, fit_cuts_and_weights, grade_documents, grades, sigmoid

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("severity", T.StringType()), ("_text", T.StringType()))])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
CALM, ANGRY = "some quiet words about weather number {} and gardens ", "you awful nastyword {} nastythings "
TEXTS = [(CALM.format(k) * (1 + k % 3)) + (ANGRY.format(k) * (k % 5) if k % 4 == 0 else "") for k in range(200)]
TOXIC = np.array([int("nasty" in t) for t in TEXTS])


def test_cuts_are_ordered_and_weights_shared():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.integers(0, 2, (n, 3)).astype(float)
    true_cuts, true_weights = np.array([0.5, 1.5, 3.0]), np.array([2.0, 1.0, -1.0])
    grade = ((x @ true_weights)[:, None] + rng.logistic(size=(n, 1)) > true_cuts).sum(axis=1)
    row, place = np.nonzero(x)
    cuts, weights = fit_cuts_and_weights(row, place, x[row, place], grade, 3)
    assert (np.diff(cuts) > 0).all() and np.abs(cuts - true_cuts).max() < 0.3 and np.abs(weights - true_weights).max() < 0.3


def test_gradient_leads_to_the_likelihood_maximum():
    rng = np.random.default_rng(1)
    row, place, value, grade = np.arange(60), rng.integers(0, 4, 60), rng.random(60) + 0.5, rng.integers(0, GRADES, 60)
    cuts, weights = fit_cuts_and_weights(row, place, value, grade, 4)

    def loss(cuts, weights):
        above = sigmoid((weights[place] * value)[:, None] - cuts)
        padded = np.concatenate([np.ones((60, 1)), above, np.zeros((60, 1))], axis=1)
        return -np.log(padded[np.arange(60), grade] - padded[np.arange(60), grade + 1]).sum() + 0.25 * (weights**2).sum()

    best = loss(cuts, weights)
    for k in range(4):
        for d in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += d
            assert loss(cuts, moved) > best - 1e-6
    for k in range(GRADES - 1):
        for d in (-0.05, 0.05):
            moved = cuts.copy()
            moved[k] += d
            assert loss(moved, weights) > best - 1e-6


def test_features_and_grades():
    rows, keys = (f := Features(pa.array(["Lousy lousyness", None, "lo"]))).keys(np.arange(len(f.row)))
    by_row = [set(keys[rows == k].tolist()) for k in range(3)]
    # The whole word and beginnings of 4 and 5 bytes; four more for the longer word, which shares two.
    assert [len(x) for x in by_row] == [7, 0, 1]
    assert grades(np.array([False, True, True, True, False]), np.array([9.0, 1, 2, 3, 0])).tolist() == [0, 1, 2, 3, 0]


def test_severity_rises_with_telling_words():
    model = fit(TEXTS, TOXIC)
    above = model.above(pa.array([CALM, CALM + "nastyword", CALM + "nastyword awful nastythings", CALM + ANGRY * 6, None, ""]))
    severity = above.sum(axis=1)
    assert (np.diff(severity[:4]) > 0).all() and (np.diff(above, axis=1) <= 0).all()
    assert above[0, 0] < 0.5 < above[2, 0] and severity[4] == severity[5] <= severity[0]


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(1000, None), (1001, ""), (None, ANGRY * 3), (5, TEXTS[5]), (5, TEXTS[5]), (1002, CALM * 20_000 + ANGRY * 4), (1003, "NASTYWORD!! Awful*** " + ANGRY)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    labels = spark.createDataFrame([(k, int(y), "x") for k, y in enumerate(TOXIC)] + [(None, 1, ""), (7, None, ""), (8, 4, "")], LABELS)
    out = grade_documents(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[None].toxic and by[1003].toxic and by[1002].toxic and not by[1000].toxic and not by[1001].toxic and by[1000].grade == 0
    assert all(0 <= r.severity <= 3 and (r.grade > 0) == r.toxic for r in out)
    # Labels of held-out documents are not learnt from.
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert sorted(map(repr, grade_documents(docs, turned).collect())) == sorted(map(repr, out))


def test_empty_tables_and_one_label(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, "nastyword", "", "")], DOCS)
    assert grade_documents(docs, labels).count() == 0
    assert not grade_documents(one, labels).first().toxic


def plain_features(text):
    """Words and their beginnings in bytes, with their numbers."""
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    return Counter(words) + Counter((p, w[:p]) for w in words for p in PREFIXES if len(w) >= p)


def test_query_equals_brute_force(spark):
    """Every row of the table: features in dictionaries, telling ones one by one, then the likelihood fit that is tested above."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "labels"))
    features = {r.doc_id: plain_features(r.text) for r in docs}
    train = {r.doc_id: r.toxic for r in labels if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    n = Counter(train.values())
    assert max(n.values()) <= SAMPLE and min(n.values()) > 0
    texts = [Counter(f for k, y in train.items() if y == c for f in features[k]) for c in (0, 1)]
    z = {}
    for f, often in texts[1].items():
        rate = (often + texts[0][f]) / len(train)
        z[f] = (often / n[1] - texts[0][f] / n[0]) / math.sqrt(max(rate * (1 - rate), 1e-12) * (1 / n[0] + 1 / n[1]))
    telling = sorted((f for f, often in texts[1].items() if often >= LEAST_TEXTS and z[f] >= LEAST_Z), key=repr)
    assert 0 < len(telling) <= FEATURES
    place = {f: k for k, f in enumerate(telling)}
    ids = sorted(train)
    held = [(row, place[f], math.log1p(number)) for row, k in enumerate(ids) for f, number in features[k].items() if f in place]
    row, at, value = (np.array(c) for c in zip(*held))
    toxic = np.array([train[k] == 1 for k in ids])
    strength = np.bincount(row, value * np.array([z[telling[k]] for k in at]), len(ids))
    cuts, weights = fit_cuts_and_weights(row, at, value, grades(toxic, strength), len(telling))
    found = {r.doc_id: r for r in op5_toxicity(spark, sf_dir).collect()}
    assert found.keys() == features.keys() and len(docs) == len(features)
    for k, counted in features.items():
        latent = sum(weights[place[f]] * math.log1p(number) for f, number in counted.items() if f in place)
        above = [1 / (1 + math.exp(-min(40.0, max(-40.0, latent - cut)))) for cut in cuts]
        severity = sum(above)
        r = found[k]
        assert abs(r.severity - severity) < 1e-6 and abs(r.p_toxic - above[0]) < 1e-6, (k, r, severity)
        assert r.toxic == (r.p_toxic >= 0.5) and r.grade == (max(1, math.floor(r.severity + 0.5)) if r.toxic else 0)


def test_held_out_precision_and_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    test = [r for r in op5_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    caught = sum(r.toxic and labels[r.doc_id] for r in test)
    assert caught / sum(r.toxic for r in test) > 0.97 and caught / sum(labels[r.doc_id] for r in test) > 0.85
