"""Whole groups out of sorted Arrow batches, for tasks that work group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which every group of equal ``key`` is complete; batches must be sorted by it."""
    held: list[pa.RecordBatch] = []  # of one group that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, with an end mark."""
    mark = np.stack(columns)
    return np.flatnonzero(np.concatenate([[True], (mark[:, 1:] != mark[:, :-1]).any(axis=0), [True]]))
