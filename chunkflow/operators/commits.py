"""Joins of chunks with their translations, and commits of new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip_harness
from .sequences import BOOK, INDEX, in_order

KEYS = [BOOK, INDEX]


def assemble_translations(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each chunk's translation, else its own text."""
    done = pairs.select(*KEYS, "translation")
    return chunks.join(done, KEYS, "left").withColumn("markdown", F.coalesce("translation", "markdown")).drop("translation")


def pending_chunks(chunks: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """What is still to be translated, of all chunks or the first `limit` of each book."""
    left = chunks.join(pairs, KEYS, "left_anti")
    return left if limit is None else left.where(F.col(INDEX) < limit)


def kept_original(pairs: DataFrame) -> DataFrame:
    return pairs.where("used_original")


def commit_pairs(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Pairs after updates (with a version, later ones win); markers are stripped."""
    new = updates.withColumn("translation", strip_harness(F.col("translation")))
    both = current.withColumn("version", F.lit(-1).cast("long")).unionByName(new)
    own = [c for c in both.columns if c not in (*KEYS, "version")]
    last = both.groupBy(*KEYS).agg(F.max_by(F.struct(*own), "version").alias("_"))
    return last.select(*KEYS, *[F.col(f"_.{c}").alias(c) for c in own])


def invalidate_reviewed(reviewed: DataFrame, retranslated: DataFrame) -> DataFrame:
    return reviewed.join(retranslated, KEYS, "left_anti")


def edit_ownership(edits: DataFrame, batch: int = 5) -> DataFrame:
    """edits with owned, and a message naming the ids of the editor's window if it isn't."""
    first = F.col("window_id") * batch
    owned = F.floor(F.col(INDEX) / batch) == F.col("window_id")
    ids = F.array_join(F.transform(F.sequence(first, first + batch - 1), lambda x: x.cast("string")), ", ")
    return edits.withColumns({"owned": owned, "message": F.when(~owned, F.concat(F.lit("err: chunk "), INDEX, F.lit(" is outside your range: "), ids))})


def review_neighbours(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows (end exclusive) with the chunk before and the one after, if they exist."""
    w = windows.join(counts.select(BOOK, "n"), BOOK)
    before = F.when(F.col("from_index") > 0, F.col("from_index") - 1)
    return w.withColumns({"before": before, "after": F.when(F.col("to_index") < F.col("n"), F.col("to_index"))}).drop("n")


def changed_pairs(pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """before, after and changed of the reviewed pairs."""
    out = pairs.join(reviewed, KEYS, "left_semi")
    before = F.coalesce("pre_review", "translation")
    return out.select(*KEYS, before.alias("before"), F.col("translation").alias("after"), (before != F.col("translation")).alias("changed"))


def join_chunks(assembled: DataFrame) -> DataFrame:
    """One markdown text per book: parts joined the way each was cut from the one before."""
    part = F.struct(F.regexp_replace("markdown", r"\s+\z", "").alias("text"), F.col("join_with").alias("seam"))
    parts = F.filter(in_order(part), lambda x: x["text"] != "")
    seam = lambda s: F.when(s == "space", " ").when(s == "line", "\n").otherwise("\n\n")
    glued = F.transform(parts, lambda x, i: F.when(i == 0, x["text"]).when(x["seam"].isNull(), F.concat(F.lit("\n\n"), x["text"])).otherwise(F.concat(seam(x["seam"]), F.regexp_replace(x["text"], r"\A[ \t]+", ""))))
    return assembled.groupBy(BOOK).agg(glued.alias("parts")).select(BOOK, F.concat(F.array_join("parts", ""), F.lit("\n")).alias("markdown"))


def split_chapters(books: DataFrame, block: int = 4096) -> DataFrame:
    """(book, markdown) -> chapter_no, title, body; level 1 and 2 headings outside fences begin one.

    Whether a line is inside a fence hangs on all lines before it. So blocks of lines are looked at
    first: whether a block turns the inside out, and how many headings it has if it begins outside
    or inside a fence. These few numbers are put in order per book; then a line's chapter follows from
    its own block. The lines of a chapter are joined within blocks before blocks are.
    """
    text = F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\A\s+|\s+\z", "")
    # a block that can't be null: else a join asks for that on one side only, and the lines are cut and shuffled twice
    lines = books.select(BOOK, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("_block", F.coalesce(F.floor(F.col("line_no") / block), F.lit(0)))
    own = Window.partitionBy(BOOK, "_block").orderBy("line_no")
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("_odd", F.sum(fence.cast("int")).over(own) % 2)
    head = ~fence & F.col("line").rlike(r"\A#{1,2} ") & (F.col("line_no") > 0)
    lines = lines.withColumns({"_if_out": (head & (F.col("_odd") == 0)).cast("int"), "_if_in": (head & (F.col("_odd") == 1)).cast("int")})
    lines = lines.withColumns({c: F.sum(c).over(own) for c in ("_if_out", "_if_in")})
    # blocks in order
    blocks = lines.groupBy(BOOK, "_block").agg(F.max_by("_odd", "line_no").alias("odd"), F.max("_if_out").alias("if_out"), F.max("_if_in").alias("if_in"))
    before = Window.partitionBy(BOOK).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1)
    blocks = blocks.withColumn("_first", F.coalesce(F.sum(F.when(F.col("_inside"), F.col("if_in")).otherwise(F.col("if_out"))).over(before), F.lit(0)))
    rows = lines.join(blocks.select(BOOK, "_block", "_inside", "_first"), [BOOK, "_block"])
    rows = rows.withColumn("part", F.col("_first") + F.when(F.col("_inside"), F.col("_if_in")).otherwise(F.col("_if_out")))
    pieces = rows.groupBy(BOOK, "_block", "part").agg(F.array_join(in_order(F.col("line"), "line_no"), "\n").alias("piece"), F.min_by("line", "line_no").alias("first"), F.count("*").alias("n"))
    parts = pieces.groupBy(BOOK, "part").agg(F.array_join(in_order(F.col("piece"), "_block"), "\n").alias("body"), F.min_by("first", "_block").alias("first"), F.sum("n").alias("n_lines"))
    # the text is trimmed and later chapters begin with a heading, so none is blank but that of an empty book
    title = F.trim(F.regexp_extract("first", r"\A#{1,2} (.*)", 1))
    return parts.select(BOOK, F.col("part").cast("int").alias("chapter_no"), title.alias("title"), F.regexp_replace("body", r"\A\s+|\s+\z", "").alias("body"), "n_lines")
