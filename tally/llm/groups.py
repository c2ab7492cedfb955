"""Whole groups from the Arrow batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of complete groups with the groups' row ranges.  The rows are
    sorted by the first ``keys`` (integer) columns; a group may span batches,
    so the last one of each batch is held back."""
    back: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if back is not None:
            table = pa.concat_tables([back, table])
        key = np.stack([table.column(c).to_numpy() for c in range(keys)])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        last = int(cut[-1]) if len(cut) else 0
        back = table.slice(last)
        if last:
            bounds = [0, *cut.tolist()]
            yield table.slice(0, last).combine_chunks(), list(zip(bounds[:-1], bounds[1:], strict=True))
    if back is not None:
        yield back.combine_chunks(), [(0, back.num_rows)]
