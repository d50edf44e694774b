"""Ranked lexical search with hashed max-sketches.

Each query ranks all documents by a sum over its terms of w * impact, where w grows with the rarity of the term and
the impact with its frequency in the document, less in long documents.

1. One pass over the texts counts documents, words and, for the terms of the queries, the documents that hold them.
2. A second pass scores. The impacts of all terms of a document are folded into a sketch of ``COORDINATES`` numbers:
   a term belongs to one coordinate by its hash, and a coordinate holds the largest impact of its terms. Looking up
   the terms of a query in the sketches of a slice of documents, all at once, gives an upper bound of each score.
3. Documents are rescored exactly in the order of falling bounds until a bound lies below the score that a document
   must reach. A task carries its best documents from slice to slice, so later slices rescore little.
4. The best of each task, ``k`` per query, meet in one ranking.

No document is shuffled. The queries are a stated set: they are read in blocks of bounded size, each with its own two
passes; the driver and a task hold one block. Terms are known by 64-bit hashes (see ``arrays.Words``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import Words, slices
from webgauge.session import materialize

TOP = 10
COORDINATES = 1024
BLOCK_CHARS = 4_000_000
SLICE_BYTES = 4 << 20
#: Documents rescored at once.
STEP = 64
DOCUMENTS, WORDS = -1, -2


class Queries:
    """The terms of one block of queries, each query's once."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.string()))
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        self.terms = [np.unique(number[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


class Statistics:
    """Documents with a term, all their words, and the weight of each term of a block."""

    def __init__(self, counts: dict[int, int], terms: int):
        self.documents, self.words = counts.get(DOCUMENTS, 0), counts.get(WORDS, 0)
        top = 2 * self.documents + 2
        self.weight = np.array([math.floor(1000 * math.log(top / (2 * counts.get(k, 0) + 1))) for k in range(terms)], dtype=np.int64)

    def impacts(self, frequency: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = 100 - 90 + (90 * length * self.documents) // self.words
        return (1_000_000_000 * frequency) // (1000 * frequency + 8 * norm)


def terms_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and frequency of each term of each text, by row and then by hash."""
    order = np.lexsort((words.hash, words.row))
    row, term = words.row[order], words.hash[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return row[first], term[first], np.diff(np.append(first, len(row)))


def _count(batches: Iterator[pa.RecordBatch], block: Broadcast) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of this task that hold a term of the block, and the two totals."""
    queries = block.value
    holding = np.zeros(len(queries.vocabulary), dtype=np.int64)
    documents = total = 0
    for part in slices(batches, "text", SLICE_BYTES):
        words = Words(part.column("text"))
        documents, total = documents + int((words.counts > 0).sum()), total + len(words.hash)
        number = queries.numbers(words.hash)
        held = np.flatnonzero(number >= 0)
        pairs = np.unique(words.row[held] * max(1, len(holding)) + number[held])
        np.add.at(holding, pairs % max(1, len(holding)), 1)
    found = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS, WORDS, *found.tolist()], pa.int64()), pa.array([documents, total, *holding[found].tolist()], pa.int64())], ["term", "n"])


def sketch(rows: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """sketch[coordinate, row]: the largest impact among the terms of a row that hash to the coordinate."""
    place = (term % np.uint64(COORDINATES)).astype(np.int64) * rows + row
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
    out = np.zeros(COORDINATES * rows)
    if len(first):
        out[place[first]] = np.maximum.reduceat(impact[order], first)
    return out.reshape(COORDINATES, rows)


class Best:
    """The ``k`` best documents of a query so far: (score, id), equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.held, self.least = k, [], 1

    def offer(self, scores: list[int], ids: list) -> None:
        self.held += [(-s, i is None, i) for s, i in zip(scores, ids) if s >= self.least]
        self.held.sort(key=lambda h: (h[0], h[1]) if h[1] else h)
        del self.held[self.k :]
        if len(self.held) == self.k:
            self.least = max(1, -self.held[-1][0])


def _score(batches: Iterator[pa.RecordBatch], block: Broadcast, statistics: Statistics, k: int) -> Iterator[pa.RecordBatch]:
    queries, best, kind = block.value, {}, None
    size = len(queries.vocabulary)
    coordinate = (queries.vocabulary % np.uint64(COORDINATES)).astype(np.int64)
    for part in slices(batches, "text", SLICE_BYTES):
        kind, ids = part.schema.field("doc_id").type, part.column("doc_id")
        words = Words(part.column("text"))
        row, term, frequency = terms_of(words)
        impact = statistics.impacts(frequency, words.counts[row]) if len(row) else frequency
        folded = sketch(part.num_rows, row, term, impact)
        number = queries.numbers(term)
        held = np.flatnonzero(number >= 0)
        # Terms stand by row and hash, and so do their numbers: the places are sorted.
        place, known = np.append(row[held] * size + number[held], np.iinfo(np.int64).max), np.append(impact[held], 0)
        for q, terms in enumerate(queries.terms):
            weight = statistics.weight[terms]
            # Sums of whole numbers, rounded at most in their last place: the margin keeps the bound above the score.
            bound = (weight.astype(np.float64) @ folded[coordinate[terms]]) * (1 + 1e-9)
            mine = best.setdefault(q, Best(k))
            order = np.flatnonzero(bound >= mine.least)
            order = order[np.argsort(-bound[order], kind="stable")]
            for at in range(0, len(order), STEP):
                some = order[at : at + STEP]
                if bound[some[0]] < mine.least:
                    break
                wanted = some[:, None] * size + terms[None, :]
                found = np.searchsorted(place, wanted)
                exact = np.where(place[found] == wanted, known[found], 0) @ weight
                mine.offer(exact.tolist(), ids.take(pa.array(some)).to_pylist())
    rows = [(q, -score, doc) for q, b in best.items() for score, _, doc in b.held]
    if rows:
        item, score, doc = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, kind)], ["item", "score", "doc_id"])


def _rank_block(docs: DataFrame, ids: list, texts: list[str], item_field: T.StructField, k: int) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries(texts)
    block = spark.sparkContext.broadcast(queries)
    counted = docs.select("text").mapInArrow(lambda b: _count(b, block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    statistics = Statistics({r["term"]: r["n"] for r in counted.collect()}, len(queries.vocabulary))
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), docs.schema["doc_id"]])
    best = docs.mapInArrow(lambda b: _score(b, block, statistics, k), kind)
    by_score = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), item_field]))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, *, k: int = TOP, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``k`` best documents of each row of ``queries``: item_id, rank (from 1), doc_id, score.

    A term is a run of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased. With N documents that hold a
    term and L words in them, a term in df documents has the weight w = floor(1000 * ln((2N + 2) / (2df + 1))); in a
    document of n words with m = 10 + 90nN div L it has the impact 10^9 * tf div (1000 * tf + 8m). The score sums
    w * impact over the terms of the query, each once; only scores above 0 are ranked, equal ones by doc_id.

    Null and empty texts have no terms: such documents are never ranked, such queries give no rows. Repeated documents
    are ranked each on its own, with equal ids in any order; queries with equal ids each give their own rows. Null
    doc_ids come after others of the same score. Other columns are not used, so their names do not matter. An empty
    table on either side gives an empty result.
    """
    source = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    asked = queries.where(F.length(item_text) > 0).select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    field = T.StructField("item_id", asked.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], T.StructType([field, T.StructField("rank", T.IntegerType()), source.schema["doc_id"], T.StructField("score", T.LongType())]))
    ids, texts, size = [], [], 0

    def flush() -> None:
        nonlocal out, ids, texts, size
        if ids:
            out = out.unionByName(materialize(_rank_block(source, ids, texts, field, k)))
        ids, texts, size = [], [], 0

    for row in asked.toLocalIterator():
        if ids and size + len(row["text"]) > block_chars:
            flush()
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    flush()
    return out
