"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and the beginnings of words (4 to 8 bytes), by count. Severity grades 0 to 3
stand in order; P(grade > k) = sigmoid(w * x - cut[k]) with one weight vector for all cuts, so that a feature
moves a text along the whole scale. The output is the expected grade.

The labels only tell toxic from not. The grades above 0 are made from the training texts themselves: a
toxic text's grade is the third, among the toxic ones, of its number of telling features.

The model is fitted on a bounded sample of labelled documents, up to ``sample`` of each label, taken by
a hash of the id. Only features that tell the labels apart in the sample go into the model, at most
``FEATURES`` of them; their number bounds what is sent to the tasks. Scoring reads every text once, in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import LOWER, Words, mix, offsets_of, slices
from webgauge.llm.quality import held_out

GRADES = 4
SAMPLE = 1500
FEATURES = 4096
PREFIXES = (4, 5, 6, 7, 8)
#: A feature goes in if it is in this many toxic texts at least, and this many standard errors more often than chance.
LEAST_TEXTS, LEAST_Z = 3, 4.0
RIDGE, STEPS, RATE = 0.5, 400, 0.05


class Features:
    """The feature keys of the words of a slice: whole words by hash, beginnings by their bytes."""

    def __init__(self, column: pa.Array):
        self.words = Words(column)
        data = np.append(LOWER[offsets_of(column)[0]], np.zeros(8, dtype=np.uint8)).astype(np.uint64)
        lead = np.zeros(len(self.words.start), dtype=np.uint64)
        for k in range(8):
            inside = self.words.start + k < self.words.end
            lead = (lead << np.uint64(8)) | np.where(inside, data[np.minimum(self.words.start + k, len(data) - 1)], 0).astype(np.uint64)
        self.lead, self.row = lead, self.words.row

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of all features of the chosen words."""
        word, key = self.keys_of(chosen)
        return self.row[word], key

    def keys_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) of all features of the chosen words."""
        lead, length = self.lead[chosen], (self.words.end - self.words.start)[chosen]
        words, keys = [chosen], [self.words.hash[chosen]]
        for p in PREFIXES:
            long = length >= p
            keys.append(mix((lead[long] >> np.uint64(8 * (8 - p))) + np.uint64(p * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF)))
            words.append(chosen[long])
        return np.concatenate(words), np.concatenate(keys)


def counts(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) with their number."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))


@dataclass
class Ordinal:
    """Sorted feature keys with weights, the ordered cuts, and the first four bytes of words worth a look."""

    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    leads: np.ndarray

    def above(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and cut."""
        latent = np.zeros(len(column))
        if len(self.keys):
            features = Features(column)
            four = features.lead >> np.uint64(32)
            near = np.searchsorted(self.leads, four)
            near[near == len(self.leads)] = 0
            row, key = features.keys(np.flatnonzero(self.leads[near] == four))
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            known = self.keys[place] == key
            row, place, number = counts(row[known], place[known])
            np.add.at(latent, row, self.weights[place] * np.log1p(number))
        return sigmoid(latent[:, None] - self.cuts[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def grades(toxic: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic; the others in thirds of their strength, ties in the lower one."""
    out = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        bounds = np.quantile(strength[toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
        out[toxic] = 1 + (strength[toxic][:, None] > bounds[None, :]).sum(axis=1)
    return out


def fit_cuts_and_weights(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge on the weights, by Adam over the whole sample.

    Cuts are the first one and positive steps (exponentials) to the next, so they stay in order.
    """
    n = len(grade)
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    start = -np.log(share / (1 - share))
    free = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 0.1)), np.zeros(n_features)])
    first, second = np.zeros_like(free), np.zeros_like(free)
    hit = np.arange(n)
    for step in range(1, STEPS + 1):
        gaps = np.exp(free[1 : GRADES - 1])
        cuts = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        latent = np.bincount(row, free[GRADES - 1 :][place] * value, n)
        above = np.concatenate([np.ones((n, 1)), sigmoid(latent[:, None] - cuts[None, :]), np.zeros((n, 1))], axis=1)
        slope = above * (1 - above)
        p = np.maximum(above[hit, grade] - above[hit, grade + 1], 1e-12)
        # d(-log p) / d latent, and through each cut.
        d_latent = -(slope[hit, grade] - slope[hit, grade + 1]) / p
        d_cuts = np.zeros(GRADES - 1)
        np.add.at(d_cuts, grade[grade > 0] - 1, (slope[hit, grade] / p)[grade > 0])
        np.add.at(d_cuts, grade[grade < GRADES - 1], -(slope[hit, grade + 1] / p)[grade < GRADES - 1])
        d_gaps = np.cumsum(d_cuts[::-1])[::-1][1:] * gaps
        d_weights = np.bincount(place, d_latent[row] * value, n_features) + RIDGE * free[GRADES - 1 :]
        gradient = np.concatenate([[d_cuts.sum()], d_gaps, d_weights])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        free -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1 : GRADES - 1]))]), free[GRADES - 1 :]


def fit(texts: list[str | None], toxic: np.ndarray) -> Ordinal:
    """The model of a sample of texts; without texts of both labels it gives every text the share of the toxic."""
    toxic = toxic.astype(bool)
    n = np.array([(~toxic).sum(), toxic.sum()], dtype=float)
    none = np.zeros(0, dtype=np.uint64)
    if not n.all():
        return Ordinal(none, np.zeros(0), np.array([20.0 if not n[1] else -20.0, 20.0, 20.0]), none)
    # Only features of enough toxic texts can be chosen: what the other texts have besides is never held.
    parts = [_counted(texts, np.flatnonzero(toxic))]
    known, often = np.unique(parts[0][1], return_counts=True)
    known = known[often >= LEAST_TEXTS]
    parts = [_among(parts[0], known), _counted(texts, np.flatnonzero(~toxic), known)]
    row, key, number = (np.concatenate(x) for x in zip(*parts))
    place = np.searchsorted(known, key)
    with_ = np.stack([np.bincount(place[toxic[row] == y], minlength=len(known)) for y in (False, True)]).astype(float)
    rate = with_.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n).sum())
    z = (with_[1] / n[1] - with_[0] / n[0]) / error
    telling = np.flatnonzero(z >= LEAST_Z)
    telling = np.sort(telling[np.argsort(-z[telling], kind="stable")[:FEATURES]])
    index = np.full(len(known), -1)
    index[telling] = np.arange(len(telling))
    chosen = index[place] >= 0
    row, place, value = row[chosen], index[place[chosen]], np.log1p(number[chosen].astype(float))
    strength = np.bincount(row, value * z[telling][place], len(toxic))
    cuts, weights = fit_cuts_and_weights(row, place, value, grades(toxic, strength), len(telling))
    return Ordinal(known[telling], weights, cuts, _leads(texts, np.flatnonzero(toxic), known[telling]))


def _parts(texts: list[str | None], index: np.ndarray) -> Iterator[tuple[np.ndarray, Features]]:
    column = pa.array([texts[k] for k in index.tolist()], pa.string())
    done = 0
    for part in slices(iter([pa.record_batch([column], ["t"])]), "t", 1 << 20):
        yield index[done : done + part.num_rows], Features(part.column("t"))
        done += part.num_rows


def _among(found: tuple[np.ndarray, ...], known: np.ndarray) -> tuple[np.ndarray, ...]:
    place = np.searchsorted(known, found[1])
    place[place == len(known)] = 0
    keep = known[place] == found[1] if len(known) else np.zeros(len(place), dtype=bool)
    return tuple(x[keep] for x in found)


def _counted(texts: list[str | None], index: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, key, number) of the features of some texts, or of those among the known ones."""
    out = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))]
    for rows, features in _parts(texts, index):
        row, key, number = counts(*features.keys(np.arange(len(features.row))))
        found = (rows[row].astype(np.int32), key, number.astype(np.int32))
        out.append(found if known is None else _among(found, known))
    return tuple(np.concatenate(x) for x in zip(*out))


def _leads(texts: list[str | None], index: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The first four bytes of the words that have one of these features."""
    out = [np.zeros(0, dtype=np.uint64)]
    for _, features in _parts(texts, index):
        word, key = features.keys_of(np.unique(features.words.hash, return_index=True)[1])
        out.append(np.unique(features.lead[word[np.isin(key, keys)]] >> np.uint64(32)))
    return np.unique(np.concatenate(out))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, sample: int) -> tuple[list, np.ndarray]:
    """Texts and labels of at most ``sample`` documents of each label, those with the smallest hash of the id.

    Held-out documents are never in it.
    """
    usable = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc)))
    ids = [usable.where(F.col(label) == y).select(F.col(doc).alias("_doc"), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("_doc"), "_doc").limit(sample) for y in (0, 1)]
    chosen = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(ids[0].unionByName(ids[1])), "_doc")
    # Repeated ids could bring more rows than labels: the bound holds for the rows too.
    rows = chosen.orderBy(F.xxhash64("_doc", "_text"), "_doc", "_text", "_label").limit(2 * sample).collect()
    return [r["_text"] for r in rows], np.array([r["_label"] for r in rows], dtype=np.int64)


def grade_documents(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (expected grade, 0 to 3), p_toxic (P(grade > 0)),
    grade (the severity in whole grades, 0 unless toxic), toxic (p_toxic >= 0.5) and held_out.

    Null and empty texts have no features and get the grade of such texts. Repeated rows are judged each on
    its own; other columns of ``docs`` are ignored. Labels other than 0 and 1, null ones, and those of held-out
    documents are not used; without toxic labels nothing is toxic.
    """
    model = fit(*labelled_sample(docs, labels, doc, text, label, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc].dataType

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "_text"):
            above = shared.value.above(rows.column("_text"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0])], ["doc_id", "severity", "p_toxic"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    judged = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(judge, schema)
    toxic = F.col("p_toxic") >= 0.5
    grade = F.when(toxic, F.greatest(F.lit(1), F.round("severity").cast("int"))).otherwise(0)
    return judged.select("doc_id", "severity", "p_toxic", grade.alias("grade"), toxic.alias("toxic"), held_out(F.col("doc_id")).alias("held_out"))
