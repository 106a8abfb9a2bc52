"""Progress of books: what is done, kept, under review, and how long the rest takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import BOOK, INDEX, chapter_ids

RECENT = 8


def last_timings(pairs: DataFrame, n: int = RECENT) -> DataFrame:
    """Per book the mean of its last n positive timings.

    Each block of indexes gives up to n rows first, so that no task orders a whole book.
    """
    rows = pairs.where("ms > 0").select(BOOK, INDEX, "ms")
    block = Window.partitionBy(BOOK, F.floor(F.col(INDEX) / 4096)).orderBy(F.desc(INDEX))
    rows = rows.withColumn("_n", F.row_number().over(block)).where(F.col("_n") <= n)
    last = Window.partitionBy(BOOK).orderBy(F.desc(INDEX))
    return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).groupBy(BOOK).agg(F.avg("ms").alias("mean_ms"))


def eta(pairs: DataFrame, remaining: DataFrame, concurrency: int = 1) -> DataFrame:
    """remaining (book, remaining) with eta_ms, null without timings or work."""
    out = remaining.join(last_timings(pairs), BOOK, "left")
    ms = F.floor(F.col("mean_ms") * F.col("remaining") / max(1, concurrency) + 0.5).cast("long")
    return out.withColumn("eta_ms", F.when(F.col("remaining") > 0, ms)).drop("mean_ms")


def progress(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per book; live_index is the first chunk not done, else the last."""
    done = pairs.select(BOOK, INDEX, F.coalesce("used_original", F.lit(False)).alias("used"), "ms", F.lit(True).alias("done"))
    rows = chunks.select(BOOK, INDEX).join(done, [BOOK, INDEX], "left")
    out = rows.groupBy(BOOK).agg(
        F.count("*").alias("total"), F.count("done").alias("done"), F.sum(F.when(F.col("used"), 1).otherwise(0)).alias("kept"),
        F.avg(F.when(F.col("ms") > 0, F.col("ms"))).alias("mean_ms"), F.coalesce(F.min(F.when(F.col("done").isNull(), F.col(INDEX))), F.max(INDEX)).alias("live_index"),
    )
    return out.withColumns({"translated": F.col("done") - F.col("kept"), "percent": F.floor(100 * F.col("done") / F.col("total") + 0.5).cast("int")})


def chapter_progress(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts and state of every chapter."""
    done = pairs.select(BOOK, INDEX, F.coalesce("used_original", F.lit(False)).alias("used"), F.lit(1).alias("is_done"))
    rows = chapter_ids(chunks).join(done, [BOOK, INDEX], "left")
    chapters = rows.groupBy(BOOK, "chapter_no").agg(
        F.min(INDEX).alias("first"), F.count("*").alias("n"), F.count("is_done").alias("done"), F.sum(F.when(F.col("used"), 1).otherwise(0)).alias("kept"), F.max(INDEX).alias("last")
    )
    live = progress(chunks, pairs.withColumn("ms", F.lit(None).cast("long"))).select(BOOK, "live_index")
    state = (
        F.when(F.col("live_index").between(F.col("first"), F.col("last")), "running")
        .when(F.col("done") == F.col("n"), F.when(F.col("kept") > 0, "kept").otherwise("done"))
        .when(F.col("done") > 0, "running")
        .otherwise("queued")
    )
    return chapters.join(live, BOOK).withColumn("state", state).drop("last", "live_index")


def review_state(windows: DataFrame, reviewed: DataFrame, batch: int = 5) -> DataFrame:
    """windows with done: whether each of their chunks was reviewed."""
    seen = reviewed.select(BOOK, INDEX).distinct().groupBy(BOOK, F.floor(F.col(INDEX) / batch).cast("int").alias("window_id")).count()
    out = windows.join(seen, [BOOK, "window_id"], "left")
    return out.withColumn("done", F.coalesce(F.col("count") >= F.col("to_index") - F.col("from_index"), F.lit(False))).drop("count")


def review_progress(windows: DataFrame, reviewed: DataFrame, batch: int = 5) -> DataFrame:
    return review_state(windows, reviewed, batch).groupBy(BOOK).agg(F.count("*").alias("total"), F.sum(F.col("done").cast("int")).alias("reviewed"))


def event_tail(events: DataFrame, limit: int = 40) -> DataFrame:
    """The last events of each book, numbered from the oldest of them."""
    recent = Window.partitionBy(BOOK).orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= limit)
    return rows.withColumn("rn", F.count("*").over(Window.partitionBy(BOOK)).cast("int") - F.col("_n") + 1).drop("_n")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(BOOK, "key").agg(F.count("*").alias("n"))
