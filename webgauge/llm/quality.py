"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the texts gives a short vector of statistics per document, stored; everything after it
works on these rows. Class counts, means and covariances are sums over the labelled training rows,
taken by ordinary aggregation over all of them. The driver gets one row of sums per class, shrinks the
covariances, and factors them once; a score is the difference of two Gaussian log densities, whose
Mahalanobis distances are products with the cached inverse Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import Words, offsets_of, run_hashes, slices
from webgauge.llm.columns import map_whole_rows, quoted
from webgauge.session import materialize

#: Share of the pooled covariance in a class covariance, and of the diagonal in that.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
#: Rows that the shrinkage target counts for besides: classes with few rows lean on it more.
PSEUDO_ROWS = 20.0
#: Scores are spread by this factor: log densities of correlated statistics are too sure of themselves.
TEMPERATURE = 3.0
#: Most labels that ``keep_good`` learns from.
SAMPLE = 200_000

KINDS = ("upper", "lower", "digit", "space", "line", "stop", "symbol", "wide")
KIND_OF = np.full(256, KINDS.index("symbol"), dtype=np.uint8)
KIND_OF[65:91], KIND_OF[97:123], KIND_OF[48:58], KIND_OF[128:] = 0, 1, 2, KINDS.index("wide")
KIND_OF[[32, 9]], KIND_OF[[10, 13]] = KINDS.index("space"), KINDS.index("line")
KIND_OF[list(b".,;:'\"?()-")] = KINDS.index("stop")

#: Statistics and, for those that are shares, the usual share in prose: it counts as ``PRIOR_UNITS`` units
#: besides those of the text, so that a text of a few words has no extreme shares.
FEATURES = {
    "length": None, "words": None, "word_length": 5.0, "upper": 0.03, "digit": 0.005, "space": 0.16, "line": 0.02, "stop": 0.15,
    "symbol": 0.01, "top_symbol": 0.01, "long_words": 0.005, "doubled_words": 0.01, "distinct_words": 1.0, "distinct_lines": 1.0,
}
PRIOR_UNITS = 20.0


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, all finite; null and empty texts have the usual shares.

    Shares are taken as logarithms, so that small ones differ as much as large ones.
    """
    data, offsets = offsets_of(column)
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = KIND_OF[data]
    count = dict(zip(KINDS, np.bincount(row * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, len(KINDS)).T.astype(float)))
    size = np.diff(offsets).astype(float)
    words = Words(column)
    n_words = words.counts.astype(float)
    length = words.end - words.start
    same = np.zeros(len(words.hash), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    lines, different_lines = _lines(data, offsets)
    symbol = kind == KINDS.index("symbol")
    by_byte = np.bincount(row[symbol] * 256 + data[symbol], minlength=n * 256).reshape(n, 256).max(axis=1, initial=0)
    part_of = {
        "word_length": (np.bincount(words.row, length, n), n_words),
        "upper": (count["upper"], count["upper"] + count["lower"]),
        "digit": (count["digit"], size),
        "space": (count["space"], size),
        "line": (count["line"], n_words),
        "stop": (count["stop"], n_words),
        "symbol": (count["symbol"], n_words),
        "top_symbol": (by_byte, n_words),
        "long_words": (np.bincount(words.row, length > 20, n), n_words),
        "doubled_words": (np.bincount(words.row, same, n), n_words),
        "distinct_words": (_distinct(words.row, words.hash, n), n_words),
        "distinct_lines": (different_lines, lines),
    }
    shares = [np.log((part + PRIOR_UNITS * FEATURES[name]) / (whole + PRIOR_UNITS)) for name, (part, whole) in part_of.items()]
    return np.stack([np.log1p(size), np.log1p(n_words), *shares], axis=1)


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each row, known by 48 bits of their hashes; a slice has fewer than 2^16 rows."""
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=n).astype(float)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text that are not empty, and how many different ones."""
    n = len(offsets) - 1
    mask = data != 10
    edge = np.concatenate([[False], mask])
    starts = np.flatnonzero(edge[1:] & ~edge[:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts = np.unique(np.concatenate([starts, inner[mask[inner]]]))
    first = (np.cumsum(mask) - 1)[starts]
    hashes = run_hashes(data[mask], first, np.diff(np.append(first, int(mask.sum()))))
    row = np.searchsorted(offsets, starts, side="right") - 1
    return np.bincount(row, minlength=n).astype(float), _distinct(row, hashes, n)


def with_statistics(docs: DataFrame, text: str, to: str = "_stats") -> DataFrame:
    """``docs`` without its text, with the statistics as an array column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, text):
            kept = [c for c in rows.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), _vectors(statistics(rows.column(text)))], [*kept, to])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(read, T.StructType([*fields, T.StructField(to, T.ArrayType(T.DoubleType()))]))


def _vectors(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


@dataclass
class Discriminant:
    """For each class: mean, inverse Cholesky factor of the covariance, and the terms that do not depend on the row."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        log = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants)]
        return 1.0 / (1.0 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -60.0, 60.0)))


def fit(sums: list[tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant | None:
    """The discriminant from (count, sum, sum of outer products) of class 0 and class 1; None if one has no rows."""
    if min(n for n, _, _ in sums) == 0:
        return None
    means = [s / n for n, s, _ in sums]
    scatter = [q - n * np.outer(m, m) for (n, _, q), m in zip(sums, means)]
    total = sum(n for n, _, _ in sums)
    pooled = sum(scatter) / total
    floor = 1e-3 + 1e-3 * np.trace(pooled) / len(pooled)
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + floor * np.eye(len(pooled))
    whiten, constants = [], []
    for (n, _, _), s in zip(sums, scatter):
        weight = (to_pooled * n + PSEUDO_ROWS) / (n + PSEUDO_ROWS)
        factor = np.linalg.cholesky((1 - weight) * s / n + weight * pooled)
        whiten.append(np.linalg.inv(factor))
        constants.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(whiten), tuple(constants))


def class_sums(rows: DataFrame, label: str, stats: str) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of class 0 and 1: one row each, aggregated over all rows."""
    d = len(FEATURES)
    places = [(i, j) for i in range(d) for j in range(i, d)]
    value = lambda i: F.col(stats)[i]
    firsts = [F.sum(value(i)).alias(f"s{i}") for i in range(d)]
    seconds = [F.sum(value(i) * value(j)).alias(f"q{i}_{j}") for i, j in places]
    out = [(0.0, np.zeros(d), np.zeros((d, d)))] * 2
    for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *firsts, *seconds).collect():
        q = np.zeros((d, d))
        for i, j in places:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        out[int(r[label])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), q)
    return out


def held_out(doc: Column) -> Column:
    """Documents whose labels are never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher is better), predicted.

    Learns from the labels 0 and 1 of documents that are not held out; a document with several labels or rows
    counts once for each. Without rows of both classes every score is 0.5. Null and empty texts are
    scored like others, by the statistics of an empty text. Null labels are not used. Other columns of
    ``docs`` are ignored.
    """
    stored = materialize(with_statistics(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text")), "_text"))
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc))).select(F.col(doc).alias("doc_id"), F.col(label).cast("int").alias("_label"))
    model = fit(class_sums(stored.join(known, "doc_id"), "_label", "_stats"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = rows.column("_stats").flatten().to_numpy().reshape(-1, len(FEATURES))
            scores = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema[doc].dataType
    scored = stored.mapInArrow(score, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns as they are.

    Fits as ``score_documents`` does, on at most ``sample`` labels (those with the smallest hashes), and then
    scores each text in place: texts are never shuffled, and read closely once but for those with labels.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc))).select(F.col(doc).alias("_doc"), F.col(label).cast("int").alias("_label"))
    # At most ``sample`` ids, so they may be broadcast: only texts that have labels are read closely for the fit.
    known = materialize(known.orderBy(F.xxhash64("_doc", "_label")).limit(sample))
    labelled = docs.select(F.col(quoted(doc)).alias("_doc"), F.col(quoted(text)).alias("_text"))
    labelled = labelled.join(F.broadcast(known.select("_doc").distinct()), "_doc", "left_semi")
    stats = materialize(with_statistics(labelled, "_text"))
    model = fit(class_sums(stats.join(known, "_doc"), "_label", "_stats"))
    if model is None:
        return docs

    def select(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, column):
            yield rows.filter(pa.array(model.scores(statistics(rows.column(column))) >= least))

    return map_whole_rows(docs, select, text)
