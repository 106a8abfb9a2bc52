"""Checks of model answers and what is accepted of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import MARKERS, image_srcs, language_prefix, link_hrefs, mostly_script, parse_response, plain_text, script_counts, script_for_lang, trim_ws
from .sequences import BOOK, INDEX

ATTEMPTS = 3


def refusal_reason(source: str = "original", translation: str = "translation") -> Column:
    """Why a translation isn't accepted, null if it is; the first rule that fails counts.

    Needs columns _src and _dst, the plain texts of both sides (see validate_pairs).
    """
    src, dst, text = F.length("_src"), F.length("_dst"), F.col(translation)
    counts = src > rules.COUNTS_FROM
    first = lambda targets, missing: F.get(F.filter(targets, missing), F.lit(0))
    image = first(image_srcs(F.col(source)), lambda x: ~F.contains(text, F.concat(F.lit("]("), x, F.lit(")"))))
    href = first(link_hrefs(F.col(source)), lambda x: x.rlike(rules.FIRM) & ~F.contains(text, x))
    failed = {
        rules.EMPTY: text.isNull() | (trim_ws(text) == ""), rules.SHORT: counts & (dst < F.greatest(F.lit(float(rules.LEAST)), src * F.lit(rules.LEAST_SHARE))),
        rules.LONG: counts & (dst > src * rules.MOST_TIMES), rules.REFUSED: F.col("_dst").rlike(rules.REFUSAL), rules.TAGS: text.rlike(MARKERS),
    }
    named = [F.when(found.isNotNull(), F.concat(F.lit(reason), found)) for reason, found in ((rules.NO_IMAGE, image), (rules.NO_HREF, href))]
    return F.coalesce(*(F.when(failed[r], r) for r in rules.REASONS if r in failed), *named)


def validate_pairs(pairs: DataFrame, source: str = "original", translation: str = "translation") -> DataFrame:
    """pairs with ok and reason."""
    texts = pairs.withColumns({"_src": plain_text(F.coalesce(source, F.lit(""))), "_dst": plain_text(F.coalesce(translation, F.lit("")))})
    return texts.withColumn("reason", refusal_reason(source, translation)).withColumn("ok", F.col("reason").isNull()).drop("_src", "_dst")


def accept_attempts(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Pairs: the first of three attempts that is valid, else after three the source itself.

    A chunk with fewer attempts, none of them valid, has no row: it is still pending. Of an attempt that
    was delivered more than once the least (answer, ms) counts. Attempts are brought together by chunk
    without the sources, one answer a number, and which numbers are there as bits; the sources
    join what is left and decide.
    """
    n, rows = F.col("attempt"), attempts.where(F.col("attempt").between(1, ATTEMPTS))
    numbers = range(1, ATTEMPTS + 1)
    seen = rows.groupBy(BOOK, INDEX).agg(F.expr("bit_or(1 << (cast(attempt as int) - 1))").alias("_seen"), *(F.min(F.when(n == k, F.struct("response", "ms"))).alias(f"_{k}") for k in numbers))
    both = seen.join(chunks.select(BOOK, INDEX, F.col("markdown").alias("original")), [BOOK, INDEX])
    # a row for each answer again, where it is: rules look at it once, and no row moves
    answer = lambda k: F.when(F.col("_seen").bitwiseAND(1 << (k - 1)) > 0, F.struct(F.lit(k).alias("attempt"), f"_{k}.response", f"_{k}.ms"))
    each = both.select(BOOK, INDEX, "original", "_seen", F.explode(F.array_compact(F.array(*map(answer, numbers)))).alias("_a"))
    each = validate_pairs(each.select(BOOK, INDEX, "original", "_seen", "_a.attempt", "_a.ms", parse_response(F.col("_a.response")).alias("translation")))
    best = each.groupBy(BOOK, INDEX).agg(
        F.min_by(F.struct("original", "translation", "ms"), F.when(F.col("ok"), F.col("attempt"))).alias("good"),
        F.max_by(F.struct("original", "reason", "ms"), "attempt").alias("last"), F.max("_seen").alias("_seen"),
    )
    kept = F.col("good").isNull()
    return best.where(~kept | (F.col("_seen") == (1 << ATTEMPTS) - 1)).select(
        BOOK, INDEX, F.col("last.original").alias("original"), F.coalesce("good.translation", "last.original").alias("translation"), kept.alias("used_original"),
        F.when(kept, F.col("last.reason")).alias("reason"), F.when(kept, F.col("last.ms")).otherwise(F.col("good.ms")).alias("ms"),
    )


def drop_target_language(blocks: DataFrame, source: Column, target: Column, section: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Blocks not yet in the target language; a section of which none would stay keeps all.

    Whether a section keeps a block is one flag per section, joined back.
    """
    src, dst = language_prefix(source), language_prefix(target)
    own = language_prefix(F.coalesce(lang, F.lit("")))
    by_mark = (own != "") & (own == dst) & (own != src)
    a, b = script_for_lang(source), script_for_lang(target)
    counts = script_counts(F.col(text))
    differ = (src != dst) & (src != "") & (dst != "") & (a != "other") & (b != "other") & (a != b)
    gone = by_mark | (differ & mostly_script(counts, b) & ~mostly_script(counts, a))
    rows = blocks.withColumn("_stays", ~F.coalesce(gone, F.lit(False)))
    any_left = rows.groupBy(*section).agg(F.max("_stays").alias("_any"))
    return rows.join(any_left, section).where("_stays or not _any").drop("_stays", "_any")
