"""Benchmark decontamination with suffix arrays over the training text.

Each task builds the suffix array of its shard, a slice of whole documents, and binary-searches every
suffix of every benchmark item in it. The interval found for the first ``window`` words holds all places
of the shard where that window stands verbatim; nothing is shuffled, because documents are never split
over shards and items are known to every task.

Suffixes that cannot match are left out of the array: a suffix is kept only while its words stand in
a run of benchmark words at least as long as the shortest window. The result is the same.

The items reach the tasks in blocks of bounded size, one broadcast each, compressed; a task unpacks one at a time.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import Words, gather, slices
from webgauge.llm.columns import fresh, map_whole_rows, quoted, without

WINDOW = 10
BLOCK_CHARS = 8_000_000
SHARD_BYTES = 4 << 20

LONGEST = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_word", T.LongType()),
        T.StructField("doc_word", T.LongType()),
        T.StructField("words", T.LongType()),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("hit_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("longest", LONGEST),
    ]
)


class TestSuffixes:
    """One block of items: their words, their windows, and their suffixes in order."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(pa.array([text for _, text in items], pa.string()))
        self.ids = [item for item, _ in items]
        self.vocabulary, inverse = np.unique(words.hash, return_inverse=True)
        # Word numbers start at 1; 0 ends an item, so that no match runs over the end.
        gaps = np.arange(len(words.hash)) + words.row
        self.text = np.zeros(len(words.hash) + len(items) + window + 1, dtype=np.int32)
        self.text[gaps] = inverse + 1
        self.row, self.place = np.full(len(self.text), -1), np.zeros(len(self.text), dtype=np.int64)
        self.row[gaps], self.place[gaps] = words.row, np.arange(len(words.hash)) - words.first[words.row]
        left = words.counts[words.row] - self.place[gaps]
        size = np.minimum(words.counts[words.row], window)
        starts = left >= size
        self.longest_item = int(words.counts.max(initial=0))
        self.ends = np.zeros(len(self.text), dtype=np.int64)  # the end of the item around each word
        self.ends[gaps] = gaps + left
        at, size = gaps[starts], size[starts]
        # Equal windows are searched once; each knows the items it stands in.
        known: dict[bytes, int] = {}
        self.window_at, self.window_size, self.window_rows = [], [], []
        for a, n in zip(at.tolist(), size.tolist()):
            k = known.setdefault(self.text[a : a + n].tobytes(), len(known))
            if k == len(self.window_at):
                self.window_at.append(a)
                self.window_size.append(n)
                self.window_rows.append(set())
            self.window_rows[k].add(int(self.row[a]))
        self.window_at = np.array(self.window_at, dtype=np.int64)
        self.window_size = np.array(self.window_size, dtype=np.int64)
        self.sorted = suffix_array(self.text, self.longest_item)
        self.sorted = self.sorted[self.text[self.sorted] > 0]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` ordered by the ``depth`` words that follow, by doubling the compared length."""
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    compared = 1
    while compared < depth and rank.max() < len(text) - 1:
        second = np.zeros(len(text), dtype=np.int64)
        second[:-compared] = rank[compared:] + 1 if compared < len(text) else 0
        rank = np.unique(rank * (len(text) + 1) + second, return_inverse=True)[1]
        compared *= 2
    return np.argsort(rank, kind="stable")


def compare(text: np.ndarray, at: np.ndarray, other: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of text[at:] against other[start:start + size], and the number of equal words before that."""
    equal = np.zeros(len(at), dtype=np.int64)
    sign = np.zeros(len(at), dtype=np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        open_ = open_[equal[open_] < size[open_]]
        a = text[np.minimum(at[open_] + equal[open_], len(text) - 1)]
        b = other[start[open_] + equal[open_]]
        sign[open_] = np.sign(a.astype(np.int64) - b)
        same = (a == b) & (b > 0)
        open_ = open_[same]
        equal[open_] += 1
    return sign, equal


def interval(order: np.ndarray, text: np.ndarray, other: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern other[start:start + size]: the part of ``order`` whose suffixes begin with it."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(order), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign, _ = compare(text, order[middle], other, start[open_], size[open_])
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


@dataclass
class Found:
    """The suffix array of a shard, and where windows begin in it."""

    text: np.ndarray
    order: np.ndarray
    #: Rank in the array, place (word number of the shard), window and its words: one entry per occurrence.
    rank: np.ndarray
    place: np.ndarray
    window: np.ndarray
    size: np.ndarray


def search(words: Words, tests: TestSuffixes) -> Found | None:
    """The occurrences of all windows in a shard."""
    none = np.zeros(0, dtype=np.int64)
    if not len(tests.window_at) or not len(words.hash):
        return None
    number = np.searchsorted(tests.vocabulary, words.hash)
    number[number == len(tests.vocabulary)] = 0
    number = np.where(tests.vocabulary[number] == words.hash, number + 1, 0)
    # Runs of benchmark words within one document that a window fits into.
    inside = number > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (words.row[1:] != words.row[:-1])
    run_of = np.cumsum(begins) - 1
    place = np.flatnonzero(inside)
    lengths = np.bincount(run_of[place]) if len(place) else none
    place = place[lengths[run_of[place]] >= tests.window_size.min()]
    if not len(place):
        return None
    runs = run_of[place]
    ends = np.flatnonzero(np.diff(runs))
    # One 0 after each run: a match never runs over the end of a run or a document.
    text = np.insert(number[place], ends + 1, 0)
    origin = np.insert(place, ends + 1, -1)
    text, origin = np.append(text, 0), np.append(origin, -1)
    order = suffix_array(text, tests.longest_item)
    # A window whose first or last word is not in the array is nowhere in it.
    present = np.zeros(len(tests.vocabulary) + 1, dtype=bool)
    present[text] = True
    ends = tests.text[tests.window_at + tests.window_size - 1]
    likely = np.flatnonzero(present[tests.text[tests.window_at]] & present[ends])
    low, high = interval(order, text, tests.text, tests.window_at[likely], tests.window_size[likely])
    rank = gather(low, high - low)
    window = np.repeat(likely, high - low)
    return Found(text, order, rank, origin[order[rank]], window, tests.window_size[window]) if len(rank) else None


def longest_matches(found: Found, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of the array where a window begins: the place in the items of its longest match, and its length.

    Every test suffix whose first word occurs in the shard is binary-searched in the training array. The suffixes
    of both sides then stand in one order, and the longest match of a training suffix is one of the two test
    suffixes next to it.
    """
    present = np.zeros(len(tests.vocabulary) + 1, dtype=bool)
    present[found.text] = True
    likely = tests.sorted[present[tests.text[tests.sorted]]]
    size = np.minimum(tests.ends[likely] - likely, tests.longest_item)
    before = interval(found.order, found.text, tests.text, likely, size)[0]
    # Test suffixes stand in order, and so do their places in the training array.
    upper = np.searchsorted(before, found.rank, side="right")
    at, best = np.zeros(len(found.rank), dtype=np.int64), np.zeros(len(found.rank), dtype=np.int64)
    own = found.order[found.rank]
    for side in (upper - 1, upper):
        fits = (side >= 0) & (side < len(likely))
        if not fits.any():
            continue
        near = likely[np.clip(side, 0, len(likely) - 1)]
        equal = np.where(fits, compare(found.text, own, tests.text, near, tests.ends[near] - near)[1], 0)
        at = np.where(equal > best, near, at)
        best = np.maximum(best, equal)
    return at, best


class Blocks:
    """The blocks of a task: compressed, but for the one in use."""

    def __init__(self, packed: list[Broadcast]):
        self.packed, self.at, self.held = packed, -1, None

    def __iter__(self) -> Iterator[TestSuffixes]:
        for k, block in enumerate(self.packed):
            if k != self.at:
                self.held = None
                self.at, self.held = k, pickle.loads(zlib.decompress(block.value))
            yield self.held


def _pack(items: list[tuple[str, str]], window: int) -> bytes:
    return zlib.compress(pickle.dumps(TestSuffixes(items, window)), 1)


def _scan(batches: Iterator[pa.RecordBatch], column: str, packed: list[Broadcast], kind: pa.StructType) -> Iterator[pa.RecordBatch]:
    blocks = Blocks(packed)
    for shard in slices(batches, column, SHARD_BYTES):
        words = Words(shard.column(column))
        covered = np.zeros(len(words.hash) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        longest: dict[int, dict] = {}
        for tests in blocks:
            hits = search(words, tests)
            if hits is None:
                continue
            place = hits.place
            np.add.at(covered, place, 1)
            np.add.at(covered, place + hits.size, -1)
            # Each window of a document once, then the items it stands in.
            for row, window in np.unique(np.stack([words.row[place], hits.window], axis=1), axis=0).tolist():
                items.setdefault(row, set()).update(tests.ids[k] for k in tests.window_rows[window])
            at, best = longest_matches(hits, tests)
            for k in np.lexsort((place, -best)).tolist():
                row = int(words.row[place[k]])
                if best[k] > longest.get(row, {"words": 0})["words"]:
                    doc_word = int(place[k] - words.first[row])
                    longest[row] = {"item_id": tests.ids[tests.row[at[k]]], "item_word": int(tests.place[at[k]]), "doc_word": doc_word, "words": int(best[k])}
        hit = np.cumsum(covered[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        n_hit = before[words.first[1:]] - before[words.first[:-1]]
        found = []
        for row in range(shard.num_rows):
            ids = sorted(items.get(row, ()))
            ranges: list[list[int]] = []
            if n_hit[row]:
                own = np.concatenate([[False], hit[words.first[row] : words.first[row + 1]], [False]])
                ranges = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2).tolist()
            sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
            n_words = int(words.counts[row])
            found.append({"n_words": n_words, "n_hit": int(n_hit[row]), "n_items": len(ids), "items_sha256": sha, "contaminated": bool(n_hit[row]), "hit_ranges": ranges, "item_ids": ids, "longest": longest.get(row)})
        yield pa.RecordBatch.from_arrays([*shard.columns, pa.array(found, kind)], [*shard.schema.names, "found"])


def item_blocks(benchmark: DataFrame, window: int, item: str, text: str, block_chars: int) -> list[Broadcast]:
    """The items in blocks of at most ``block_chars`` characters (one item at least), each broadcast.

    The driver holds one block at a time. Items without text or id cannot be reported and are left out.
    """
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    context = benchmark.sparkSession.sparkContext
    blocks, held, size = [], [], 0
    for key, value in rows.toLocalIterator():
        if held and size + len(value) > block_chars:
            blocks.append(context.broadcast(_pack(held, window)))
            held, size = [], 0
        held.append((key, value))
        size += len(value)
    return [*blocks, context.broadcast(_pack(held, window))] if held else blocks


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, match: str = "match") -> DataFrame:
    """Every row of ``docs`` with a column ``match``: what of the benchmark stands in it verbatim.

    ``match`` holds n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256,
    contaminated (n_hit > 0), hit_ranges (word ranges, end exclusive), item_ids (sorted as strings)
    and longest, the longest verbatim match: item, place in the item, place in the document, words.

    A window is ``window`` consecutive words of an item; a shorter item with a word is one window. Null and
    empty texts have no words and never match; an empty benchmark matches nothing; repeated rows are
    judged each on its own; columns of ``docs`` pass through, except that one with the name given by ``match`` is replaced.
    Items with equal ids count as one item; items with a null id or text are left out.
    """
    blocks = item_blocks(benchmark, window, item, item_text, block_chars)
    source = docs.select(*[F.col(quoted(c)) for c in without(docs, match)])
    kind = _arrow(FOUND)
    return map_whole_rows(source, lambda batches, column: _scan(batches, column, blocks, kind), text, T.StructField(match, FOUND))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[kind]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; see ``find_matches``."""
    match = fresh(docs, "match")
    return find_matches(docs, benchmark, **options, match=match).where(~F.col(f"{match}.contaminated")).drop(match)
