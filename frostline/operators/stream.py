"""Sorted rows inside mapInArrow, given out a key at a time: a task streams through many keys and holds the rows of one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def run_starts(rows: pa.RecordBatch | pa.Table, *keys: str) -> np.ndarray:
    """Where the runs of equal keys begin; nulls are equal."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = rows[k].combine_chunks() if isinstance(rows, pa.Table) else rows[k]
        coded = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= coded[1:] != coded[:-1]
    return np.flatnonzero(new)


def by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Each key with all its rows, of rows sorted by the keys."""
    held: list[pa.RecordBatch] = []
    key: tuple = ()
    for batch in batches:
        begins = run_starts(batch, *keys).tolist()
        for low, high in zip(begins, [*begins[1:], batch.num_rows], strict=False):
            this = tuple(batch[k][low].as_py() for k in keys)
            if held and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(low, high - low))
    if held:
        yield key, pa.Table.from_batches(held)


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of the given sizes, one after another in flat."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after another (null values: NaN), and the lists' sizes; a null list has none."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(array.offsets.to_numpy())
    if array.null_count:
        sizes = np.where(array.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return array.flatten().to_numpy(zero_copy_only=False), sizes
