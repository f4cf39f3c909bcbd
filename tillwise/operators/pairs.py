"""Counts of pairs of numbered items, in few bytes per pair.

A pair is one whole number. A task sorts the pairs of some millions, merges equal ones and hands
on, per part of all pairs, the gaps from one to the next and the counts, byte by byte, so that
what is shuffled takes three bytes or so per pair instead of two texts and a counter. A part is
added up by one task at a time and is of bounded size, as there are as many parts as pairs call for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pairs that a task sorts at once, and those of a part.
AT_ONCE = 1 << 22
PER_PART = 1 << 21
PACKED = "part bigint, size int, gaps binary, counts binary"
COUNTED = "a bigint, b bigint, pair_count bigint, spare bigint"


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their next ones, as far as any is not 0."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, : len(data) // size] = np.frombuffer(data, np.uint8).reshape(-1, size).T
    return out.view("<u8").ravel().astype(np.int64)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each row's lists, ``AT_ONCE`` or one row's at a time; rows of equal lengths together."""
    lists = [batch.column(name) for name in ("left", "right")]
    starts = [c.offsets.to_numpy()[:-1] for c in lists]
    values = [c.values.to_numpy(zero_copy_only=False) for c in lists]
    lengths = np.stack([np.diff(c.offsets.to_numpy()) for c in lists], 1).astype(np.int64)
    lengths[lists[1].is_null().to_numpy(zero_copy_only=False), 1] = -1
    kinds, kind = np.unique(lengths, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    bounds = np.searchsorted(kind.ravel()[order], np.arange(len(kinds) + 1))
    for k, (n, m) in enumerate(kinds.tolist()):
        i, j = np.triu_indices(n, 1) if m < 0 else (np.repeat(np.arange(n), m), np.tile(np.arange(m), n))
        rows = order[bounds[k] : bounds[k + 1]]
        step = max(1, AT_ONCE // 4 // max(1, len(i)))
        for part in (rows[at : at + step] for at in range(0, len(rows), step)) if len(i) else ():
            left = values[0][starts[0][part][:, None] + np.arange(n)]
            right = left if m < 0 else values[1][starts[1][part][:, None] + np.arange(m)]
            yield left[:, i].ravel(), right[:, j].ravel()


def pair_counts(lists: DataFrame, space: int, total: float, least: int, most: int) -> DataFrame:
    """How many rows of ``lists`` hold each pair of items: ``a`` < ``b``, ``pair_count``, ``spare``.

    A row's pairs are those within its array ``left`` or, with an array ``right``, crosswise. An
    entry is a number below ``space``, times ``least`` + 1, plus a reserve of at most ``least``. A
    pair may ``spare`` the smaller reserve of its two items, or 0 if that is ``least``; those
    whose count and spare fall short of ``least`` are left out. ``total`` is about the number of
    all pairs, with repeats; ``most`` is 0 if all reserves are.
    """
    parts = max(1, math.ceil(total / PER_PART))
    across, width = -(-space // parts), max(1, most)
    stride = space * across * width
    if stride * parts >= 1 << 63:
        raise ValueError(f"Too many items to pair: {space}.")

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        merged = np.concatenate(keys)
        keys.clear()
        merged.sort()
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        counts, merged = np.diff(first, append=len(merged)), merged[first]
        part = merged // stride
        merged -= part * stride
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
        ranges = list(zip(at, [*at[1:], len(merged)]))
        columns = [
            pa.array(part[at], pa.int64()),
            pa.array([b - a for a, b in ranges], pa.int32()),
            pa.array([_bytes(np.diff(merged[a:b], prepend=0)) for a, b in ranges], pa.binary()),
            pa.array([_bytes(counts[a:b]) for a, b in ranges], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "size", "gaps", "counts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, waiting = [], 0
        for batch in batches:
            for one, other in _pairs(batch):
                x, y = one // (least + 1), other // (least + 1)
                low, high = np.minimum(x, y), np.maximum(x, y)
                key = (low + high) % parts * stride + (low * across + high // parts) * width
                if most:
                    spare = np.minimum(one % (least + 1), other % (least + 1))
                    key += np.where(spare < least, spare, 0)
                keys.append(key)
                waiting += len(key)
                if waiting >= AT_ONCE:
                    yield packed(keys)
                    waiting = 0
        if waiting:
            yield packed(keys)

    def added(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sizes = table.column("size").to_pylist()
        read = lambda name: [_numbers(v.as_py(), n) for v, n in zip(table.column(name), sizes)]
        keys, counts = np.concatenate([np.cumsum(g) for g in read("gaps")]), np.concatenate(read("counts"))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        spare = keys % width
        kept = counts + spare >= least
        keys, counts, spare = keys[kept] // width, counts[kept], spare[kept]
        low = keys // across
        high = keys % across * parts + (part - low) % parts
        return pa.table({"a": low, "b": high, "pair_count": counts, "spare": spare})

    return lists.mapInArrow(pack, PACKED).groupBy("part").applyInArrow(added, COUNTED)
