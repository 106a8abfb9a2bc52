"""Token, price and time estimates; the model catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DENSE, tokens, tokens_for_lang
from .sequences import BOOK, INDEX

#: Fixed values of the estimate.
GUIDE, GLOSSARY, GLOSSARY_OUT, REVIEW_OUT, STYLE_OUT, VERIFY_OUT = 1500, 800, 400, 600, 900, 1200
MS_CHUNK, MS_GLOSSARY, MS_REVIEW = 9000, 7000, 12000


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def book_sizes(chunks: DataFrame) -> DataFrame:
    """Per book: chunks, average characters, whether its first chunk's script is dense."""
    dense = F.substring("markdown", 1, 2000).rlike(DENSE)
    sizes = chunks.groupBy(BOOK).agg(F.count("*").alias("chunks"), F.sum(F.length("markdown")).alias("chars"), F.min_by(dense, INDEX).alias("dense"))
    return sizes.withColumn("avg_chars", F.col("chars") / F.greatest(F.col("chunks"), F.lit(1)).cast("double"))


def estimate_cost(chunks: DataFrame, settings: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Tokens, price and time of all passes over each book.

    settings: book, target_lang, concurrency, glossary_batch, review_batch and, for prices,
    provider_id and model. One aggregation over the chunks; the rest is arithmetic.
    """
    b = book_sizes(chunks).join(settings, BOOK)
    n, avg = F.col("chunks"), F.col("avg_chars")
    g_batch, r_batch, conc = (F.greatest(F.lit(1), F.coalesce(c, F.lit(d))) for c, d in (("glossary_batch", 4), ("review_batch", 5), ("concurrency", 1)))
    t = tokens(avg, F.col("dense"))
    o = F.when(F.coalesce("target_lang", F.lit("")) == "", t).otherwise(tokens_for_lang(avg, F.col("target_lang")))
    b = b.withColumns({"_t": t, "_o": o, "_g": F.ceil(n / g_batch), "_r": F.ceil(n / r_batch), "_tg": tokens(avg * g_batch, F.col("dense"))})
    t, o, g, r = (F.col(c) for c in ("_t", "_o", "_g", "_r"))
    reads = r_batch * 2 + 2
    steps = reads + 2
    review_in = r * ((GUIDE + GLOSSARY) * steps + (t + o) / 2.0 * reads * ((steps * (steps + 1) / 2.0) / steps))
    style_in = GUIDE * 6 + t * F.least(F.lit(10), F.greatest(n, F.lit(1))) * 3.5
    total_in = (t + GUIDE + GLOSSARY + t + o) * n + g * (GUIDE + F.col("_tg")) + review_in + style_in + (GUIDE + t + o) * 4
    total_out = F.ceil(o * F.lit(1.15)) * n + g * GLOSSARY_OUT + r * REVIEW_OUT + STYLE_OUT + VERIFY_OUT
    eta = g * MS_GLOSSARY + n * MS_CHUNK / conc + r * MS_REVIEW / conc
    out = b.withColumns({"input_tokens": half_up(total_in), "output_tokens": half_up(total_out), "eta_ms": half_up(eta)})
    if prices is not None:
        out = model_price(out, prices)
        usd = F.col("input_tokens") / 1e6 * F.col("price_in") + F.col("output_tokens") / 1e6 * F.col("price_out")
        out = out.withColumn("usd", usd)
    return out.drop("_t", "_o", "_g", "_r", "_tg", "chars", "avg_chars", "dense")


def model_price(jobs: DataFrame, prices: DataFrame, fallback: DataFrame | None = None, free: list[str] = (), aggregators: list[str] = ("openrouter",)) -> DataFrame:
    """jobs (provider_id, model) with price_in, price_out and source.

    Free models cost nothing; else the first price in catalog order (column ord) of that
    model under any provider, then the fallback's; else both are null.
    """
    known = prices.where("input_per_million is not null or output_per_million is not null")
    first = known.groupBy("model_id").agg(F.min_by(F.struct("input_per_million", "output_per_million"), "ord").alias("_p"))
    out = jobs.join(first, F.col("model") == F.col("model_id"), "left").drop("model_id")
    zero = F.col("model").endswith(":free") | (F.col("provider_id").isin(list(free)) & ~F.col("provider_id").isin(list(aggregators)) if free else F.lit(False))
    price_in, price_out, has_fb = F.col("_p.input_per_million"), F.col("_p.output_per_million"), F.lit(False)
    if fallback is not None:
        fb = fallback.select(F.col("model_id").alias("_m"), F.struct("input_per_million", "output_per_million").alias("_fb"))
        out = out.join(fb, F.col("model") == F.col("_m"), "left").drop("_m")
        has_fb = F.col("_fb").isNotNull()
        price_in, price_out = (F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(f"_fb.{c}")) for c in ("input_per_million", "output_per_million"))
    source = F.when(zero, "fallback").when(F.col("_p").isNotNull(), "catalog").when(has_fb, "fallback").otherwise("unknown")
    out = out.withColumns({"price_in": F.when(zero, 0.0).otherwise(price_in), "price_out": F.when(zero, 0.0).otherwise(price_out), "source": source})
    return out.drop("_p", "_fb")


def scale_cost(cost: DataFrame, n: Column) -> DataFrame:
    """An estimate for the first n chunks, pro rata."""
    total = F.greatest(F.col("chunks"), F.lit(1))
    n = F.least(F.greatest(n, F.lit(0)), total)
    f = n / total.cast("double")
    part = {c: half_up(F.col(c) * f) for c in ("input_tokens", "output_tokens", "eta_ms")}
    if "usd" in cost.columns:
        part["usd"] = F.col("usd") * f
    return cost.withColumns(part | {"chunks": n})


def model_catalog(curated: DataFrame, catalog: DataFrame, live: DataFrame, fallback: DataFrame, free: bool = False) -> DataFrame:
    """Models in list order: live ones as given, then free ones, then by price and id.

    curated and catalog hold id, ord and prices, of which later ones win; live holds id, ord.
    The list is one report, ordered as a whole.
    """
    rows = curated.select("id", F.lit(0).alias("late"), "ord", "input_per_million", "output_per_million")
    rows = rows.unionByName(catalog.select("id", F.lit(1).alias("late"), "ord", "input_per_million", "output_per_million"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("late", "ord"))).alias(c)
    known = rows.groupBy("id").agg(last("input_per_million"), last("output_per_million"))
    first = live.groupBy("id").agg(F.min("ord").alias("live_ord"))
    out = known.join(first, "id", "full").join(fallback.select("id", F.col("input_per_million").alias("fi"), F.col("output_per_million").alias("fo")), "id", "left")
    gratis = F.lit(free) | F.col("id").endswith(":free")
    price = lambda c, f: F.when(gratis, 0.0).otherwise(F.coalesce(c, f))
    out = out.withColumns({"input_per_million": price("input_per_million", "fi"), "output_per_million": price("output_per_million", "fo")})
    paid = F.when(F.col("live_ord").isNull(), F.when(F.col("id").endswith(":free") | (F.col("input_per_million") == 0), 0).otherwise(1))
    order = [F.asc_nulls_last("live_ord"), paid, F.when(F.col("live_ord").isNull(), F.coalesce("input_per_million", F.lit(float("inf")))), "id"]
    return out.orderBy(*order).select("id", "input_per_million", "output_per_million", "live_ord")


def match_models(models: DataFrame, query: str, id_col: str = "id") -> DataFrame:
    q = query.strip().lower()
    return models.where(F.contains(F.lower(id_col), F.lit(q))) if q else models
