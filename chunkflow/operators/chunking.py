"""Documents to chunks: narrow passes over the texts, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.cutting import DEFAULT_CHARS, WORD_CLASS, Text, blocks, chunks, slack_of
from .sequences import in_order

LEAST_CHARS, MOST_CHARS = 800, 20_000
#: Characters of text in a batch of rows that leaves a task.
BATCH_CHARS = 1 << 20


def clamp_chars(chunk_chars: float | None) -> int:
    """The chunk size a user asked for, within its bounds."""
    if chunk_chars is None or chunk_chars != chunk_chars or abs(chunk_chars) == float("inf"):
        return DEFAULT_CHARS
    return min(MOST_CHARS, max(LEAST_CHARS, round(chunk_chars)))


def _explode_text(df: DataFrame, text: str, cut: Callable[[str | None], Iterable[tuple]], fields: list[StructField], size: int) -> DataFrame:
    """df without its text column, a row for every tuple that cut(text) gives; item `size` of it is text.

    Rows leave as they are made, so a task holds a text, its batch and about BATCH_CHARS of pieces.
    """
    kept = [c for c in df.columns if c != text]
    schema = StructType([df.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows, chars = [], [], 0

            def made(of=of, rows=rows, batch=batch) -> pa.RecordBatch:
                old = [batch.column(k).take(pa.array(of, pa.int64())).cast(arrow.field(k).type) for k in range(len(kept))]
                new = [pa.array([r[k] for r in rows], arrow.field(len(kept) + k).type) for k in range(len(fields))]
                return pa.RecordBatch.from_arrays([*old, *new], schema=arrow)

            for i, t in enumerate(batch.column(len(kept))):
                for row in cut(t.as_py()):
                    of.append(i)
                    rows.append(row)
                    chars += len(row[size])
                    if chars >= BATCH_CHARS:
                        yield made()
                        of.clear()
                        rows.clear()
                        chars = 0
            if rows:
                yield made()

    return df.select(*kept, text).mapInArrow(run, schema)


def split_blocks_of(df: DataFrame, text: str = "markdown") -> DataFrame:
    """A row for each fenced block, heading or paragraph, numbered by pos."""
    return _explode_text(df, text, lambda t: enumerate(blocks(t or "")), [StructField("pos", IntegerType()), StructField("block", StringType())], 1)


def chunk_documents(sections: DataFrame, max_chars: int = DEFAULT_CHARS, text: str = "markdown") -> DataFrame:
    """A row for each chunk: part_pos, markdown, join_with, with the section's other columns."""
    cut = lambda t: ((i, m, j) for i, (m, j) in enumerate(chunks(t, max_chars)))
    fields = [StructField("part_pos", IntegerType()), StructField("markdown", StringType()), StructField("join_with", StringType())]
    return _explode_text(sections.withColumnRenamed(text, "_text"), "_text", cut, fields, 1)


def chunk_quality(chunks: DataFrame, docs: DataFrame, key: str, text: str, max_chars: int = DEFAULT_CHARS) -> DataFrame:
    """Per document: whether its chunks add up to it, split no word or fence, and their sizes."""
    parts = chunks.groupBy(key).agg(in_order(F.col("markdown"), "part_pos").alias("parts"))
    word = lambda c: c.rlike(f"^[{WORD_CLASS}]$")
    seams = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: word(F.right(F.get("parts", i - 1), F.lit(1))) & word(F.left(F.get("parts", i), F.lit(1))))
    split_words: Column = F.when(F.size("parts") > 1, F.size(F.filter(seams, lambda x: x))).otherwise(0)
    fences = F.size(F.filter("parts", lambda p: F.regexp_count(p, F.lit("(?m)^```")) % 2 == 1))
    longest = F.array_max(F.transform("parts", F.length))
    # of the texts only digests move
    out = docs.select(key, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_text")).join(parts, key, "left")
    return out.select(
        key, F.coalesce(F.size("parts"), F.lit(0)).alias("chunks"), F.coalesce(F.length(F.array_join("parts", "")), F.lit(0)).alias("total_chars"),
        (F.md5(F.coalesce(F.array_join("parts", ""), F.lit(""))) == F.col("_text")).alias("intact"), F.coalesce(split_words, F.lit(0)).alias("split_words"),
        F.coalesce(fences, F.lit(0)).alias("split_fences"), F.coalesce(longest <= max_chars + slack_of(max_chars), F.lit(True)).alias("within_limit"),
    )


def best_cut(text: Column, start: Column, max_chars: int = DEFAULT_CHARS) -> Column:
    """Where the piece of a text that begins at start ends; null for a null text."""

    @F.pandas_udf(IntegerType())
    def run(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Text(t).next_cut(int(s), max_chars) for t, s in zip(texts, starts, strict=True)], dtype="Int32")

    return run(text, start)
