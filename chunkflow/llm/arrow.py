"""Arrow batches in portions of bounded size, so that a task holds about a megabyte of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a portion.
BYTES = 1 << 20


def runs(sizes: list[int], most: int = BYTES) -> Iterator[slice]:
    """Runs of items whose sizes add up to about `most`, or single larger items."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


def portions(batch: pa.RecordBatch, text: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of which column `text` holds about `most` bytes, or single longer rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for run in runs([n + 500 for n in sizes], most):
        yield batch.slice(run.start, run.stop - run.start)


class Memory(dict):
    """What was worked out lately, by key: two generations of at most `most` entries.

    When the young one is full the old one is forgotten, so what recurs stays.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
