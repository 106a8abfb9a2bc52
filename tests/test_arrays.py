"""Portions of texts into Python, batches of rows out of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from chunkflow.functions import arrays
from chunkflow.sources import books, packing


class Rows:
    """Stands in for a DataFrame: keeps the function that mapInArrow gets."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, schema):
        self.f = f
        return self


def test_portions_hold_about_as_many_bytes():
    array = pa.array(["x" * 400, None, "y" * 5000, "", "z"])
    parts = [p.to_pylist() for p in arrays.portions(array, 1500)]
    assert sum(parts, []) == array.to_pylist() and parts[1] == ["y" * 5000] and len(parts) == 3
    assert list(arrays.portions(pa.array([], pa.string()))) == []


def test_small_rows_leave_together_and_large_ones_soon(monkeypatch):
    schema = pa.schema([("a", pa.int64()), ("b", pa.binary())])
    rows = [(k, b"x") for k in range(900)]
    (one,) = arrays.in_batches(rows, schema)
    assert one.num_rows == 900 and list(arrays.in_batches([], schema)) == []
    assert [b.num_rows for b in arrays.in_batches([(k, b"x" * 2000) for k in range(4)], schema, 4000)] == [2, 2]


def test_books_leave_a_task_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "_stream", lambda *_: Rows())
    rows = [(k, role, 0, name, None, "t", None) for k in range(200) for role, name in ((0, f"{k}.epub"), (1, "c"))]
    names = ["book_id", "_role", "_no", "name", "kind", "text", "data"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    out = list(packing.pack_books(spark.createDataFrame([], "book_id long"), None, "de").f([batch]))
    assert len(out) == 1 and out[0].num_rows == 200
    files = pa.RecordBatch.from_arrays([pa.array(map(str, range(200))), out[0].column(1), out[0].column(2)], ["book_id", "file_name", "content"])
    monkeypatch.setattr(books.F, "col", lambda c: F.lit(c))
    (sections,) = books.extract_sections(Rows()).f([files])
    assert sections.num_rows == 200 and set(sections.column(2).to_pylist()) == {"ok"}


def test_each_text_keeps_order_and_nulls(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("ab"), 1000)).alias("t"))
    got = df.select("id", arrays.each_text(lambda x: f"{len(x)}", F.col("t")).alias("n")).collect()
    assert all(r.n == ("2000" if r.id % 7 else None) for r in got) and len(got) == 3000
