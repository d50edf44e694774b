"""Token ids in Parquet files: list columns with controlled encodings, row groups and page indexes.

Documents are put into ascending order of their id by a range exchange, encoded in that order and written
by Spark's own Parquet writer, so a failed task only repeats its file. A file holds for each document
the ids with an end id after them, and in columns of their own the id of the document, the number of ids
and the place in the file. Because Parquet keeps columns, pages and their index apart, a reader of
lengths or of some documents never touches the other ids.

Encoding: a text is cut into pieces exactly as the byte-level BPE does before merging, and a piece is
encoded by the tokenizers library once per task process and looked up afterwards. Texts with a feature
the vectorised cut does not cover (characters beyond the tables below, contractions, the tokenizer's
own special strings) are encoded whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from webgauge.llm.arrays import gather, run_hashes, slices
from webgauge.session import materialize, shared_dir

#: Writer settings: row groups, pages, and delta encoding (format version 2 uses it when a column has no
#: dictionary). Columns are indexed by page in every case. Ids are small numbers with few repeats of
#: long runs: a dictionary of them pays off, lengths and places are better as differences.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
CACHE_PIECES = 1_000_000
SLICE_BYTES = 4 << 20

LETTER, DIGIT, SPACE, BLANK, OTHER = 1, 2, 3, 4, 5
#: Code points below this are classed by table; texts with others are encoded whole.
TABLE_END = 0x250


def _classes() -> np.ndarray:
    table = np.full(TABLE_END, OTHER, dtype=np.uint8)
    for k in range(TABLE_END):
        if chr(k).isalpha():
            table[k] = LETTER
        elif chr(k).isnumeric():
            table[k] = DIGIT
        elif chr(k).isspace() and not 0x1C <= k <= 0x1F:
            table[k] = BLANK
    table[0x20] = SPACE
    return table


class Encoder:
    """Texts to ids, with the pieces met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level token has as many characters as it stands for bytes.
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)
        self.classes = _classes()
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(ends, np.flatnonzero((points >= TABLE_END) | (points == ord("'"))), side="right")] = True
        odd |= np.array([any(s in t for s in self.special) for t in texts], dtype=bool)
        if not odd.any():
            return self._by_piece(points, ends)
        ids, counts = self._by_piece(points[~np.repeat(odd, lengths)], np.cumsum(lengths[~odd]))
        slow = self.whole([t for t, o in zip(texts, odd.tolist()) if o])
        all_counts = np.zeros(len(texts), dtype=np.int64)
        all_counts[~odd], all_counts[odd] = counts, [len(x) for x in slow]
        out = np.empty(int(all_counts.sum()), dtype=np.int32)
        mine = np.repeat(~odd, all_counts)
        out[mine] = ids
        out[~mine] = np.concatenate(slow)
        return out, all_counts

    def _by_piece(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(ends), dtype=np.int64)
        first = piece_starts(self.classes[points], ends)
        length = np.diff(np.append(first, len(points)))
        hashes = run_hashes(points, first, length)
        unique, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._places(unique, points, first[sample], length[sample])[inverse]
        size = self.size[place]
        before = np.concatenate([[0], np.cumsum(size)])
        by_text = before[np.searchsorted(first, ends)]
        return self.ids[gather(self.at[place], size)], np.diff(np.concatenate([[0], by_text]))

    def _places(self, unique: np.ndarray, points: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where the cache holds each of the distinct pieces, after encoding those it lacks."""
        if len(self.hashes) > CACHE_PIECES:
            self.clear()
        place = np.searchsorted(self.hashes, unique)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == unique[known]
        if known.all():
            return place
        new = np.flatnonzero(~known)
        ids, counts = self._encode_pieces(points, first[new], length[new])
        self.at = np.insert(self.at, place[new], len(self.ids) + np.cumsum(counts) - counts)
        self.size = np.insert(self.size, place[new], counts)
        self.hashes = np.insert(self.hashes, place[new], unique[new])
        self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.hashes, unique)

    def _encode_pieces(self, points: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces. Those that end in no white space are encoded in joint texts with a line end
        after each, which never merges with a piece; the byte lengths of the tokens tell where a piece ends."""
        blank = (self.classes[points[first + length - 1]] == SPACE) | (self.classes[points[first + length - 1]] == BLANK)
        joint, alone = np.flatnonzero(~blank), np.flatnonzero(blank)
        found, counts = [], np.zeros(len(first), dtype=np.int64)
        groups = np.array_split(joint, -(-len(joint) // 4000)) if len(joint) else []
        for group in groups:
            stops = np.cumsum(length[group] + 1) - 1
            text = np.full(int(stops[-1]) + 1, ord("\n"), dtype=np.uint32)
            text[np.delete(np.arange(len(text)), stops)] = points[gather(first[group], length[group])]
            ids = self.whole([text.tobytes().decode("utf-32-le")])[0]
            byte_ends = np.cumsum(1 + (text >= 0x80))[stops]  # no code point here takes more than two bytes
            ends = np.cumsum(self.token_bytes[ids])
            line_ends = np.searchsorted(ends, byte_ends)
            if not (ends[line_ends] == byte_ends).all() or not (self.token_bytes[ids[line_ends]] == 1).all():
                raise ValueError("the tokenizer does not cut texts at line ends as expected")
            counts[group] = np.diff(np.concatenate([[-1], line_ends])) - 1
            found.append(np.delete(ids, line_ends))
        each = self.whole([points[f : f + n].tobytes().decode("utf-32-le") for f, n in zip(first[alone].tolist(), length[alone].tolist())])
        counts[alone] = [len(x) for x in each]
        flat = np.concatenate([*found, *each])
        order = np.concatenate([joint, alone])
        at = np.zeros(len(first), dtype=np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return flat[gather(at, counts)], counts


def piece_starts(classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces begin: runs of letters, digits or other signs, each with one blank before it, and runs
    of white space, whose last character is left to what follows (in the piece only if it is a blank)."""
    n = len(classes)
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[0] = True
    text_start[ends] = True
    space = (classes == SPACE) | (classes == BLANK)
    kind = np.where(space, BLANK, classes)
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= text_start[:-1]
    # A run of white space that is not at the end of its text gives up its last character.
    run_end = np.empty(n, dtype=bool)
    run_end[-1] = True
    run_end[:-1] = start[1:]
    last = space & run_end & ~text_start[1:]
    start |= last
    # That character, if it is a blank, begins the next piece; otherwise it is a piece of its own.
    follows = np.flatnonzero(last & (classes == SPACE)) + 1
    start[follows] = False
    return np.flatnonzero(start)


_encoders: dict[str, Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    part, place = TaskContext.get().partitionId(), 0
    for rows in slices(batches, "_text", SLICE_BYTES):
        ids, counts = encoder.encode(["" if t is None else t for t in rows.column("_text").to_pylist()])
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        with_ends = np.full(offsets[-1], end_id, dtype=np.int32)
        keep = np.ones(len(with_ends), dtype=bool)
        keep[offsets[1:] - 1] = False
        with_ends[keep] = ids
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(with_ends))
        part_start = place + offsets[:-1]
        place += int(offsets[-1])
        columns = [rows.column("_id"), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(part_start), pa.array(counts + 1), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, doc: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Write the ids of ``docs`` to a new folder ``path`` of Parquet files in ascending order of ``doc``.

    Columns: doc_id, part (number of the file's task), part_start (ids of the part before the document),
    n_tokens (with the end id) and ids. Null texts count as empty: they have the end id only. Rows with a null
    id come first; rows with equal ids are ordered by the hash of their text. ``tokenizer`` is a path that
    every executor can read.
    """
    kind = docs.schema[doc].dataType
    # Ties in a hot id are spread by the hash, so the ranges stay even.
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_tie")
    fields = [("doc_id", kind), ("part", T.IntegerType()), ("part_start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([T.StructField(n, t, n == "doc_id") for n, t in fields])
    options = {
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "compression": "zstd",
    }
    ordered.select("_id", "_text").mapInArrow(lambda batches: _encode(batches, tokenizer, end_id), schema).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder with ``start``: the number of ids of all documents before each.

    Only the totals of the parts, one row for each file's task, are added up; a reader that does not ask
    for ``ids`` does not read them.
    """
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("_n"))
    return stored.join(part_offsets(totals), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before", "part_start")


def part_offsets(totals: DataFrame) -> DataFrame:
    """(part, _before) from one row per part, which are as many as the tasks that wrote the files."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return materialize(totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crcs = [zlib.crc32(values[b:e].tobytes()) for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        columns = [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit numbers."""
    kind = tokens.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]])
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
