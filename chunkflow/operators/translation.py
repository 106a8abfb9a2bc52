"""Translation of windows by a plug-in function, each window a fold with preceding context."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.checking import parse_answer, problem
from .commits import KEYS, invalidate_reviewed, kept_original
from .sequences import BOOK, INDEX, neighbours

#: Takes source texts and for each the (original, translation) pairs before it.
Translator = Callable[[list[str], list[list[tuple[str, str]]]], list[str]]
#: How many pairs before a chunk are its context.
LOOK = 2
PAIRS = "chunk_index int, original string, translation string, used_original boolean, reason string, ms long, failure string"
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _one(translator: Translator, source: str, context: list[tuple[str, str]], attempts: int) -> dict:
    """The first answer that passes, else the source; a failure if the translator raises."""
    start, reason = time.monotonic(), None
    for _ in range(attempts):
        try:
            answer = translator([source], [context])[0]
        except Exception as e:  # a plug-in may fail in any way; the chunk stays pending
            return {"failure": f"{type(e).__name__}: {e}"}
        text = parse_answer(answer or "")
        reason = problem(source, text)
        if reason is None:
            return {"translation": text, "used_original": False, "ms": int(1000 * (time.monotonic() - start))}
    return {"translation": source, "used_original": True, "reason": reason, "ms": int(1000 * (time.monotonic() - start))}


def translate_windows_run(chunks: DataFrame, translator: Translator, attempts: int = 3) -> DataFrame:
    """chunks (book, window_id, chunk_index, markdown) -> pairs, with failure where one stopped.

    A window is translated in order, with the two pairs before each chunk in the same window
    as context; all windows run at once. Windows pass through a task in order, one after another,
    so it holds two pairs at a time. When the translator raises, the window stops there and
    gives one row with the failure; its other chunks stay pending.
    """
    kind = chunks.schema[BOOK].dataType
    fields = [f.split() for f in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, stopped = None, {}, False
        for batch in batches:
            rows = []
            for book, window, at, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (book, window):
                    now, done, stopped = (book, window), {}, False
                if stopped:
                    continue
                got = _one(translator, source or "", [done[k] for k in (at - 2, at - 1) if k in done], attempts)
                rows.append({INDEX: at, "original": source} | got | {BOOK: book})
                stopped = "failure" in got
                if not stopped:
                    done = {k: done[k] for k in done if k == at - 1} | {at: (source, got["translation"])}
            columns = [pa.array([r[BOOK] for r in rows], batch.column(0).type)]
            columns += [pa.array([r.get(name) for r in rows], ARROW[of]) for name, of in fields]
            yield pa.RecordBatch.from_arrays(columns, [BOOK, *(name for name, _ in fields)])

    rows = chunks.select(BOOK, "window_id", F.col(INDEX).cast("int").alias(INDEX), "markdown").repartition(BOOK, "window_id").sortWithinPartitions(BOOK, "window_id", INDEX)
    return rows.mapInArrow(run, StructType([StructField(BOOK, kind), *StructType.fromDDL(PAIRS).fields]))


def retry_chains(kept: DataFrame, block: int = 4096) -> DataFrame:
    """kept (book, chunk_index) with `chain`, the index that its chain begins at.

    Kept chunks at most LOOK apart see one another when they are tried again, others don't: such runs
    are found in blocks of a book, and only the last start of each block is put in order.
    """
    own = Window.partitionBy(BOOK, "_block").orderBy(INDEX)
    near = neighbours(kept.select(*KEYS).distinct(), LOOK, block)
    alone = F.coalesce(F.col(INDEX) - F.lag(INDEX).over(own) > LOOK, F.lit(True))
    rows = near.withColumn("_start", F.when(alone, F.col(INDEX))).where("_own")
    before = Window.partitionBy(BOOK).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(BOOK, "_block").agg(F.max("_start").alias("_last"))
    last = last.select(BOOK, "_block", F.max("_last").over(before).alias("_before"))
    here = F.max("_start").over(own)
    return rows.withColumn("_here", here).join(last, [BOOK, "_block"]).select(*KEYS, F.coalesce("_here", "_before").alias("chain"))


def retry_kept(pairs: DataFrame, reviewed: DataFrame, translator: Translator, attempts: int = 3, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(pairs, reviewed) after another try at the chunks whose source was kept.

    Context is each chunk's two neighbours before it, as they stand. A new pair replaces the
    old one whole; what is translated now counts as not reviewed. Each chain of kept chunks (see
    retry_chains) is tried in order with the pairs ahead of it, all chains at once.
    """
    chains = retry_chains(kept_original(pairs), block)
    near = chains.select(BOOK, "chain", F.explode(F.sequence(F.col(INDEX) - LOOK, F.col(INDEX))).alias(INDEX)).distinct()
    rows = pairs.select(*KEYS, "original", "translation", "used_original").join(near, KEYS).select(*KEYS, "original", "translation", "used_original", "chain")
    kind, index = pairs.schema[BOOK].dataType, pairs.schema[INDEX].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, {}
        for batch in batches:
            out = []
            for book, at, original, text, used, chain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (book, chain):
                    now, last = (book, chain), {}
                got = _one(translator, original or "", [last[k] for k in range(at - LOOK, at) if k in last], attempts) if used else {}
                if got.get("used_original") is False:
                    text = got["translation"]
                    out.append((book, at, text, got["ms"]))
                last = {k: last[k] for k in last if k > at - LOOK} | {at: (original, text)}
            types = [batch.column(0).type, batch.column(1).type, pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [BOOK, INDEX, "translation", "ms"])

    rows = rows.repartition(BOOK, "chain").sortWithinPartitions(BOOK, "chain", INDEX)
    new = rows.mapInArrow(run, StructType([StructField(BOOK, kind), StructField(INDEX, index), StructField("translation", StringType()), StructField("ms", LongType())]))
    fresh = new.select(*KEYS, F.col("translation").alias("_t"), F.col("ms").alias("_ms"))
    out = pairs.join(fresh, KEYS, "left")
    got = F.col("_t").isNotNull()
    changes = {"translation": F.coalesce("_t", "translation"), "used_original": F.when(got, False).otherwise(F.col("used_original"))}
    for c, value in (("reason", None), ("pre_review", None), ("ms", F.col("_ms"))):
        if c in pairs.columns:
            changes[c] = F.when(got, F.lit(value) if value is None else value).otherwise(F.col(c))
    return out.withColumns(changes).drop("_t", "_ms"), invalidate_reviewed(reviewed, fresh)
