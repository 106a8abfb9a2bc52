"""Chunk sequences of books: positions, batches, windows, chapters (rows keyed by book)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOOK = "book_id"
INDEX = "chunk_index"


def in_order(value: Column, order: str = INDEX) -> Column:
    """Aggregate: the values of a group as an array, in the order of their index."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("value"))))
    return F.transform(pairs, lambda x: x["value"])


def index_chunks(parts: DataFrame) -> DataFrame:
    """parts (book, piece_pos, part_pos, ...) with the book-wide chunk_index, from 0.

    Only the sizes of the pieces are put in order, so a huge book isn't sorted in one task.
    """
    sizes = parts.groupBy(BOOK, "piece_pos").agg(F.count("*").alias("n"))
    before = Window.partitionBy(BOOK).orderBy("piece_pos").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(BOOK, "piece_pos", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(BOOK, "piece_pos").orderBy("part_pos")) - 1
    return parts.withColumn("rank", rank).join(first, [BOOK, "piece_pos"]).withColumn(INDEX, (F.col("first") + F.col("rank")).cast("int")).drop("first", "rank")


def big_chunks(chunks: DataFrame, batch: int = 4) -> DataFrame:
    """Runs of `batch` chunks with their texts joined; both ends are inclusive."""
    big = F.floor(F.col(INDEX) / batch).cast("int").alias("big_id")
    return chunks.groupBy(BOOK, big).agg(
        F.min(INDEX).alias("from_index"), F.max(INDEX).alias("to_index"), F.array_join(in_order(F.col("markdown")), "").alias("markdown")
    )


def _windows(counts: DataFrame, size: Column) -> DataFrame:
    """counts (book, n) -> windows of `size`; the end is exclusive."""
    ids = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("size")).cast("int") - 1)).alias("window_id")
    cut = counts.where("n > 0").withColumn("size", size.cast("int")).select(BOOK, "n", "size", ids)
    return cut.select(
        BOOK, "window_id", (F.col("window_id") * F.col("size")).cast("int").alias("from_index"), F.least(F.col("n"), (F.col("window_id") + 1) * F.col("size")).cast("int").alias("to_index")
    )


def translate_windows(chunks: DataFrame, parallel: int = 1, limit: int | None = None) -> DataFrame:
    """At most `parallel` equal windows of each book, or of its first `limit` chunks."""
    counts = chunks.groupBy(BOOK).agg(F.count("*").alias("n"))
    if limit is not None:
        counts = counts.withColumn("n", F.least(F.col("n"), F.lit(max(0, limit))))
    return _windows(counts, F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(parallel), F.col("n")))))


def review_windows(chunks: DataFrame, batch: int = 5) -> DataFrame:
    return _windows(chunks.groupBy(BOOK).agg(F.count("*").alias("n")), F.lit(max(1, batch)))


def review_slots(pending: DataFrame, concurrency: int = 1) -> DataFrame:
    """pending (book, window_id) with the slot that reviews each."""
    rank = F.row_number().over(Window.partitionBy(BOOK).orderBy("window_id")) - 1
    n = F.count("*").over(Window.partitionBy(BOOK))
    size = F.ceil(n / F.greatest(F.lit(1), F.least(F.lit(concurrency), n)))
    return pending.withColumn("slot", F.floor(rank / size).cast("int"))


def chapter_ids(chunks: DataFrame, block: int = 4096) -> DataFrame:
    """chunks with chapter_no: runs of equal title and path count up from 0.

    Runs are counted in blocks of a book; only the blocks' counts are put in order.
    Indexes have no gaps.
    """
    own = Window.partitionBy(BOOK, "_block").orderBy(INDEX)
    here = F.struct(F.coalesce("chapter_title", F.lit("")), F.coalesce("document_path", F.lit("")))
    rows = neighbours(chunks, 1, block).withColumn("_new", F.when(F.lag(here).over(own).eqNullSafe(here), 0).otherwise(1)).where("_own")
    before = Window.partitionBy(BOOK).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(BOOK, "_block").agg(F.sum("_new").alias("_n"))
    counts = counts.select(BOOK, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = rows.join(counts, [BOOK, "_block"])
    return rows.withColumn("chapter_no", (F.col("_first") + F.sum("_new").over(own) - 1).cast("int")).drop("_new", "_first", "_block", "_own")


def chapter_ranges(chunks: DataFrame) -> DataFrame:
    """Chapters as inclusive ranges of chunks."""
    return chapter_ids(chunks).groupBy(BOOK, "chapter_no").agg(
        F.min_by("chapter_title", INDEX).alias("title"), F.min_by("document_path", INDEX).alias("document_path"), F.min(INDEX).alias("from_index"), F.max(INDEX).alias("to_index")
    )


def chapter_list(chunks: DataFrame) -> DataFrame:
    """One text per book: a line for each chapter with its 1-based chunks."""
    title = F.trim(F.coalesce("title", F.lit("")))
    title = F.when(title != "", title).otherwise(F.concat(F.lit("Untitled "), F.col("chapter_no") + 1))
    line = F.concat(F.lit("# "), title, F.lit(" (chunks from "), F.col("from_index") + 1, F.lit(" to "), F.col("to_index") + 1, F.lit(")"))
    return chapter_ranges(chunks).groupBy(BOOK).agg(F.array_join(in_order(line, "chapter_no"), "\n").alias("chapters"))


def longest_chunk(chunks: DataFrame) -> DataFrame:
    """The index of each book's longest chunk, the first of several."""
    size = F.struct(F.length("markdown"), -F.col(INDEX))
    return chunks.groupBy(BOOK).agg(F.max_by(INDEX, size).alias(INDEX))


def style_sample(chunks: DataFrame) -> DataFrame:
    """The chunks at positions 0, 1, a third, two thirds and the last of each book."""
    n = chunks.groupBy(BOOK).agg(F.count("*").alias("n"))
    at = F.array(F.lit(0), F.lit(1), F.floor(F.col("n") / 3), F.floor(F.col("n") * 2 / 3), F.col("n") - 1)
    at = n.select(BOOK, F.explode(F.array_distinct(F.filter(at.cast("array<int>"), lambda x: x < F.col("n")))).alias(INDEX))
    return chunks.join(at, [BOOK, INDEX])


def neighbours(chunks: DataFrame, before: int, block: int = 4096) -> DataFrame:
    """chunks with a block number; each block also has the `before` rows ahead of it.

    A window over (book, block) then sees its neighbours, and a book that holds much of
    the table is spread over many tasks. own marks the rows that aren't such copies.
    """
    at = F.array_distinct(F.array(F.floor(F.col(INDEX) / block), F.floor((F.col(INDEX) + before) / block)))
    return chunks.withColumn("_block", F.explode(at)).withColumn("_own", F.col("_block") == F.floor(F.col(INDEX) / block))


def context_pairs(chunks: DataFrame, pairs: DataFrame, k: int = 2, windowed: bool = False) -> DataFrame:
    """chunks with `context`, the pairs at the k indexes before; a missing pair gives nothing.

    windowed: chunks has window_id, and pairs of earlier windows aren't seen.
    """
    rows = chunks.join(pairs.select(BOOK, INDEX, "original", "translation"), [BOOK, INDEX], "left")
    rows = neighbours(rows, k)
    pair = F.when(F.col("translation").isNotNull(), F.struct(F.col(INDEX).alias("at"), "original", "translation"))
    keys = [BOOK, "_block", *["window_id"] * windowed]
    near = F.collect_list(pair).over(Window.partitionBy(*keys).orderBy(INDEX).rangeBetween(-k, -1))
    return rows.withColumn("context", F.array_sort(near)).where("_own").drop("_block", "_own", "original", "translation")
