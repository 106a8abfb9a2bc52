"""Term lists of books: candidates, merging, parsing, texts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import trim_ws
from .sequences import BOOK, in_order

ENTRIES = ArrayType(StructType([StructField("src", StringType()), StructField("dst", StringType())]))


def glossary_candidates(big_chunks: DataFrame, top: int = 24) -> DataFrame:
    """big_chunks with `names`: up to `top` distinct capitalised words, first seen first."""
    found = F.regexp_extract_all("markdown", F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z]{2,}(?![A-Za-z0-9_])"), F.lit(0))
    return big_chunks.withColumn("names", F.slice(F.array_distinct(found), 1, top))


def candidate_rows(big_chunks: DataFrame, top: int = 24) -> DataFrame:
    """A row for each candidate of glossary_candidates(): pos and src, with the other columns.

    An outer generate, as Spark would test an inner one's array in a filter and so look for the words twice.
    """
    named = glossary_candidates(big_chunks, top)
    kept = [c for c in named.columns if c not in ("names", "markdown", "pos", "src")]
    return named.select(*kept, F.posexplode_outer("names").alias("pos", "src")).where(F.col("src").isNotNull())


def merge_glossary(seed: DataFrame, extracts: DataFrame) -> DataFrame:
    """The first entry of each book and source form wins: seed, then big_id, then pos.

    A minimum per (book, src), which is combined before the shuffle however frequent a name is.
    """
    rows = seed.select(BOOK, F.lit(0).alias("prio"), F.lit(0).alias("big_id"), "pos", "src", "dst")
    rows = rows.unionByName(extracts.select(BOOK, F.lit(1).alias("prio"), "big_id", "pos", "src", "dst"))
    rows = rows.withColumns({"src": trim_ws(F.col("src")), "dst": trim_ws(F.col("dst"))})
    rows = rows.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    first = rows.groupBy(BOOK, "src").agg(F.min(F.struct("prio", "big_id", "pos", "dst")).alias("x"))
    return first.select(BOOK, F.struct("x.prio", "x.big_id", "x.pos").alias("ord"), "src", F.col("x.dst").alias("dst"))


def upsert_glossary(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Later updates (by seq) win and keep the place of the source form's first entry."""
    new = updates.select(BOOK, F.col("seq").alias("at"), trim_ws(F.col("src")).alias("src"), trim_ws(F.col("dst")).alias("dst"), F.lit(1).alias("late"))
    new = new.where((F.col("src") != "") & (F.col("dst") != ""))
    both = current.select(BOOK, F.col("pos").alias("at"), "src", "dst", F.lit(0).alias("late")).unionByName(new)
    place = F.struct("late", "at")
    return both.groupBy(BOOK, "src").agg(F.min(place).alias("ord"), F.max_by("dst", place).alias("dst"))


def glossary_text(books: DataFrame, glossary: DataFrame) -> DataFrame:
    """One text per book of `src — dst` lines in order, `(none yet)` without entries."""
    line = F.concat_ws(" — ", "src", "dst")
    texts = glossary.groupBy(BOOK).agg(F.array_join(in_order(line, "ord"), "\n").alias("glossary"))
    return books.select(BOOK).distinct().join(texts, BOOK, "left").withColumn("glossary", F.coalesce("glossary", F.lit("(none yet)")))


def parse_glossary_lines(texts: DataFrame) -> DataFrame:
    """(book, text) of lines `src -> dst` to rows (book, pos, src, dst)."""
    lines = texts.select(BOOK, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", trim_ws(F.col("line")))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    lines = lines.withColumn("parts", F.split("line", r"\s*(?:->|—|–|\|)\s*", -1)).where(F.size("parts") >= 2)
    return lines.select(BOOK, "pos", F.col("parts")[0].alias("src"), F.array_join(F.expr("slice(parts, 2, size(parts) - 1)"), " | ").alias("dst"))


def glossary_entries(answer: str | None) -> list[dict[str, str]]:
    """The string entries of the JSON object in a model's answer, in written order."""
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", answer or "", re.I)
    raw = fenced[1] if fenced else answer or ""
    start, end = raw.find("{"), raw.rfind("}")
    try:
        found = json.loads(raw[start : end + 1]) if 0 <= start < end else {}
    except (ValueError, RecursionError):
        found = {}
    pairs = [(k.strip(), v.strip()) for k, v in found.items() if isinstance(v, str)] if isinstance(found, dict) else []
    return [{"src": k, "dst": v} for k, v in pairs if k and v]


def parse_glossary_json(answer: Column) -> Column:
    """ARRAY<STRUCT<src, dst>>; written order matters, so JSON is read in Python."""

    @F.pandas_udf(ENTRIES)
    def parse(answers: pd.Series) -> pd.Series:
        return pd.Series([glossary_entries(a) for a in answers], dtype=object)

    return parse(answer)


def accept_extracts(attempts: DataFrame) -> DataFrame:
    """Of each big chunk the entries of the first attempt that has some or is an empty answer.

    Without such an attempt among three there are none.
    """
    rows = attempts.where("attempt <= 3").withColumn("entries", parse_glossary_json(F.col("response")))
    bare = trim_ws(F.coalesce("response", F.lit("")))
    good = (F.size("entries") > 0) | bare.isin("", "{}")
    entries = F.coalesce(F.min_by("entries", F.when(good, F.col("attempt"))), F.max_by("entries", "attempt"))
    return rows.groupBy(BOOK, "big_id").agg(entries.alias("entries"))
