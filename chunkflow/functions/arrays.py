"""Texts into Python and rows out of it, about a megabyte at a time.

What a task holds as Python objects doesn't hang on how many rows Spark puts into a batch; and since
each batch that leaves a task has a price of milliseconds, small rows leave it together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of a portion, and what a row is taken to have beside its texts.
BYTES, ROW = 1 << 20, 500


def portions(array: pa.Array, most: int = BYTES) -> Iterator[pa.Array]:
    """Slices of an array of texts with about `most` bytes each, or single longer ones."""
    start = total = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(array), 0).to_pylist()):
        if k > start and total + n + ROW > most:
            yield array.slice(start, k - start)
            start, total = k, 0
        total += n + ROW
    if start < len(array):
        yield array.slice(start)


def _size(value: object) -> int:
    return len(value) if isinstance(value, (str, bytes)) else ROW * len(value) if isinstance(value, list) else 0


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows as they come, in batches that end once they hold `most` bytes."""
    held: list[tuple] = []
    total = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        total += ROW + sum(map(_size, row))
        if total >= most:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def each_text(f: Callable[[str | bytes], str | None], c: Column) -> Column:
    """f of every value of a text or binary column; null stays null."""

    @F.arrow_udf(StringType())
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            if not len(array):
                yield pa.array([], pa.string())
            for part in portions(array):
                yield pa.array([None if x is None else f(x) for x in part.to_pylist()], pa.string())

    return run(c)
