"""Work on many small groups of rows inside one task: rows come sorted by their group's columns, groups go out one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def each_group(keys: tuple[str, ...], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow after repartition and sortWithinPartitions by whole-number keys: work's result for each group.

    Only one group and one batch are held at a time, so memory follows the largest group.
    """

    def bounds(t: pa.Table) -> np.ndarray:
        a = np.stack([t.column(c).to_numpy() for c in keys])
        return np.concatenate([[0], np.flatnonzero((a[:, 1:] != a[:, :-1]).any(axis=0)) + 1, [t.num_rows]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = [r for a, b in zip(cuts[:-1], cuts[1:]) if b > a and (r := work(t.slice(a, b - a))) is not None and r.num_rows]
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            cuts = bounds(t)
            yield from out(t, cuts[:-1])
            held = t.slice(cuts[-2])  # the last group may go on in the next batch
        if held is not None and held.num_rows:
            yield from out(held, np.array([0, held.num_rows]))

    return run
