"""Reading sorted Arrow batches group by group inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def keyed_runs(batches, key: list[str]):
    """For batches sorted by integer key columns: (table, bounds), where rows
    bounds[i]:bounds[i+1] of the table are whole groups.  A group cut by a batch's
    end is carried over to the next."""
    rest: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table) - 1, bool)
        for k in key:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        at = cut(table)
        if not len(at):
            rest.append(batch)
            continue
        last = int(at[-1])
        yield table.slice(0, last), np.concatenate([[0], at])
        rest = table.slice(last).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.concatenate([[0], cut(table), [len(table)]]).astype(int)
