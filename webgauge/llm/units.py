"""Units of work of the pair operators: bounded groups of rows that meet in one task."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from webgauge.llm.arrays import gather


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit together; a unit may run over several batches, but is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "p", "q")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for s, e in zip(edges[:-1], edges[1:]):
            part = batch.slice(s, e - s)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("bucket", "p", "q")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def whole_units(batches: Iterator[pa.RecordBatch], least: int = 4000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Many whole units at a time, ``least`` rows or more but for the last ones, with the number of each row's unit."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if not held or (batch is not None and sum(b.num_rows for b in held) < least):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "p", "q")])
        new = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        end = table.num_rows if batch is None else int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if end:
            yield table.slice(0, end), np.concatenate([[0], np.cumsum(new[: end - 1])])
        held = table.slice(end).to_batches()


def pairs_between(unit: np.ndarray, left: np.ndarray, right: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row of ``left`` with each row of ``right`` of the same unit, about ``at_once`` pairs at a time.

    Both are ascending row numbers; the pairs of one row are never cut.
    """
    if not len(left) or not len(right):
        return
    number = np.bincount(unit[right], minlength=int(unit[-1]) + 1)
    first, length = (np.cumsum(number) - number)[unit[left]], number[unit[left]]
    total = np.cumsum(length)
    begin = 0
    while begin < len(left):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, side="right")))
        yield np.repeat(left[begin:end], length[begin:end]), right[gather(first[begin:end], length[begin:end])]
        begin = end


def to_batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def root_of(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k
