import math

import numpy as np
import pytest
from pyspark.sql import types as T

from webgauge.llm import whitening
from webgauge.llm.queries import op11_whitening

VECTORS = T.StructType([T.StructField("vec_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()), T.StructField("component", T.StringType())])


def brute(rows, count=16):
    """(vec_id, n, deviation, whitened by component), and what each component explains."""
    usable = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) and abs(e) < 1e14 for e in v)]
    sizes = [len(v) for _, v in usable]
    size = max(sizes, key=lambda s: (sizes.count(s), s)) if sizes else 0
    whole = [(i, tuple(math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v)) for i, v in usable if len(v) == size]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    centred = np.array([off(x) for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    live = values > 1e-13 * values[0]
    values, vectors = values[live], vectors[:, live]
    out = [(i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), off(x) @ vectors / np.sqrt(values)) for i, x in whole]
    return out, values / np.trace(centred.T @ centred / n)


def check(df, rows, tolerance=1e-9):
    expected, explained = brute(rows)
    got = df.collect()
    assert len(got) == len(expected) * len(explained)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    signs = None
    for vec, n, deviation, whitened in expected:
        mine = sorted(by[vec], key=lambda r: r.component)
        assert all(r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None) for r in mine)
        for copy in range(len(mine) // len(explained)):
            w = np.array([r.whitened for r in mine[copy :: len(mine) // len(explained)]])
            signs = np.where(w * whitened < 0, -1, 1) if signs is None else signs
            assert np.abs(w * signs - whitened).max() < tolerance


def test_eigenvalues_and_vectors_of_hard_matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    cases = [
        (q * np.r_[np.full(5, 9.0), np.full(30, 2.0), np.zeros(5)]) @ q.T,
        (q * 10.0 ** -np.arange(40)) @ q.T,
        (q * (1 + 1e-9 * np.arange(40))) @ q.T,
        wilkinson @ wilkinson.T, np.diag(np.arange(1.0, 9)), np.eye(6), np.array([[3.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]), np.zeros((3, 3)),
    ]
    for a in cases:
        a = (a + a.T) / 2
        values, vectors = whitening.leading_components(a, 16)
        exact = np.linalg.eigvalsh(a)[::-1]
        norm = max(abs(exact[0]), 1e-300)
        assert np.abs(values - exact[: len(values)]).max(initial=0) < 1e-13 * norm * len(a)
        assert len(values) == min(16, (exact > whitening.LEAST * norm).sum()) or abs(exact[len(values)]) < 1e-12 * norm
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
        assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-12 * norm


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.normal(size=12), rng.normal(size=11)
    exact = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-5, 5, 101)
    assert (whitening.count_below(d, e, at) == (exact[None, :] < at[:, None]).sum(axis=1)).all()


def test_packing_is_exact_and_canonical():
    for x in ([0, 1_000_127], [1_000_128, 999_872], [0, 2_000_000], [1 << 40, -(1 << 52)], [5]):
        x = np.array(x, dtype=np.int64)
        assert (whitening.unpack([whitening.pack(x)])[0] == x).all()
    assert len(whitening.pack(np.array([1_000_063] * 64))) == 65


@pytest.mark.parametrize("spread", [1.0, 1e7])
def test_equals_brute_force_on_odd_rows(spark, spread):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 20)) * np.linspace(1, 6, 20) * spread).astype(np.float32)
    rows = [(f"v{k}", v.tolist()) for k, v in enumerate(x)]
    rows += [(f"copy{k}", x[0].tolist()) for k in range(50)] + [("twice", x[1].tolist())] * 2 + [(None, x[2].tolist())]
    rows += [("null", None), ("empty", []), ("hole", [None] + [1.0] * 19), ("nan", [float("nan")] * 20), ("inf", [float("-inf")] * 20), ("huge", [3e38] * 20), ("short", [1.0] * 7), ("zero", [0.0] * 20)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(4)
    check(whitening.whiten_vectors(df), rows)


def test_few_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "c", "c") for r in rows], VECTORS)
    empty = whitening.whiten_vectors(frame([]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten_vectors(frame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])])).count() == 0
    rows = [("a", [1.0, 2.0, 0.0]), ("b", [3.0, 5.0, 0.0]), ("c", [3.0, 5.0, 0.0])]
    out = whitening.whiten_vectors(frame(rows)).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(out)] == [("a", 1, 2), ("b", 1, 2), ("c", 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1.0 for r in out)


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op11_whitening(spark, sf_dir), rows)
