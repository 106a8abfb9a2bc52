"""Request tables for batch inference and chat histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_token_budget
from .commits import review_neighbours
from .sequences import BOOK, in_order

TRANSLATE_SYSTEM = "Translate the SOURCE block from {source} to {target}. Keep markdown, link targets and image paths. Use the glossary's forms.\n\nSTYLE GUIDE:\n"
GLOSSARY_SYSTEM = "List the names and terms of the SOURCE block that must stay the same in {target}, as one JSON object from source to target form.\n\nSTYLE GUIDE:\n"


def message(role: str, content) -> F.Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _source(markdown: str = "markdown"):
    return F.concat(F.lit("<<<SOURCE>>>\n"), F.col(markdown), F.lit("\n<<<END_SOURCE>>>"))


def translate_requests(chunks: DataFrame, glossary: DataFrame, guide: DataFrame, source: str = "en", target: str = "ru") -> DataFrame:
    """chunks with context (context_pairs) -> messages and max_tokens.

    The whole glossary text of the book goes into every request, so write the result once.
    """
    rows = chunks.join(glossary, BOOK, "left").join(guide, BOOK, "left")
    one = lambda x, i: F.concat(F.lit("<prev"), i + 1, F.lit("><original>\n"), x["original"], F.lit("\n</original><translate>\n"), x["translation"], F.lit("\n</translate></prev"), i + 1, F.lit(">"))
    recent = F.array_join(F.transform("context", one), "\n")
    recent = F.when(recent == "", "(start of book)").otherwise(recent)
    user = F.concat(F.lit("GLOSSARY:\n"), F.coalesce("glossary", F.lit("(none yet)")), F.lit("\n\nPREVIOUS TWO CHUNKS:\n"), recent, F.lit("\n\n"), _source())
    system = F.concat(F.lit(TRANSLATE_SYSTEM.format(source=source, target=target)), F.coalesce("style_guide", F.lit("")))
    return rows.select(*[c for c in chunks.columns if c not in ("context", "markdown")], F.array(message("system", system), message("user", user)).alias("messages"), output_token_budget(F.length("markdown")).alias("max_tokens"))


def glossary_requests(big_chunks: DataFrame, guide: DataFrame, target: str = "ru") -> DataFrame:
    """One request for each big chunk."""
    system = F.concat(F.lit(GLOSSARY_SYSTEM.format(target=target)), F.coalesce("style_guide", F.lit("")))
    most = F.least(F.lit(2048), output_token_budget(F.least(F.length("markdown"), F.lit(4000)))).cast("long")
    return big_chunks.join(guide, BOOK, "left").select(BOOK, "big_id", F.array(message("system", system), message("user", _source())).alias("messages"), most.alias("max_tokens"))


def review_requests(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with the ids they own, their neighbours as text and their step budget."""
    w = review_neighbours(windows, counts)
    ids = F.array_join(F.transform(F.sequence("from_index", F.col("to_index") - 1), lambda x: x.cast("string")), ", ")
    near = F.array_join(F.filter(F.array(F.col("before").cast("string"), F.col("after").cast("string")), lambda x: x.isNotNull()), " and ")
    steps = F.least(F.lit(60), 6 + 5 * (F.col("to_index") - F.col("from_index")))
    return w.withColumns({"ids": ids, "neighbours": near, "max_steps": steps}).drop("before", "after")


def normalise_chat(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """One array per conversation: system texts joined in front, then user and assistant turns."""
    all_ = messages.groupBy(key).agg(in_order(F.struct("role", F.col(text).alias("content")), order).alias("all"))
    system = F.array_join(F.transform(F.filter("all", lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    rest = F.filter("all", lambda m: m["role"].isin("user", "assistant"))
    head = F.when(system != "", F.array(message("system", system))).otherwise(F.slice(rest, 1, 0))
    return all_.select(key, F.concat(head, rest).alias("messages"))


def last_user_message(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The last user turn of each conversation, empty if it has none."""
    last = F.max_by(text, F.when(F.col("role") == "user", F.col(order)))
    return messages.groupBy(key).agg(F.coalesce(last, F.lit("")).alias("text"))
