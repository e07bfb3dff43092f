"""Groups of rows that arrive sorted in a task, without holding more than one incomplete group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal `keys`, whole groups, several at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key).to_numpy()
            last &= column == column[-1]
        other = np.flatnonzero(~last)
        end = other[-1] + 1 if len(other) else 0
        same = bool(held) and all(
            held[-1].column(key)[-1].as_py() == batch.column(key)[0].as_py() for key in keys
        )
        if held and (end or not same):
            yield pa.Table.from_batches([*held, batch.slice(0, end)] if same else held)
            if not same and end:
                yield pa.Table.from_batches([batch.slice(0, end)])
            held = []
        elif end:
            yield pa.Table.from_batches([batch.slice(0, end)])
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table | pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Where the groups of a table from `grouped` begin and end."""
    edge = np.zeros(table.num_rows, bool)
    edge[:1] = True
    for key in keys:
        column = table.column(key).to_numpy()
        edge[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(edge).tolist()
    return zip(starts, [*starts[1:], table.num_rows])
