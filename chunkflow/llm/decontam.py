"""Benchmark decontamination by the q-gram lemma (operator 5).

Texts and items are lower-cased and everything but letters and digits becomes one space.
An item is seen as overlapping segments of SEGMENT characters, one every STRIDE (a shorter item
is one), and a document holds a segment if some stretch of it is within the edit budget, RATE of
the segment's length. Each edit spoils at most q of a segment's q-grams, so such a stretch
shares at least n - q + 1 - q * budget of them with it, and all of those lie in a diagonal
band as wide as the budget. Shared q-grams are counted in bands that overlap by half, then
by segment; what reaches the bound is verified by banded alignment. Items of fewer than SHORTEST
characters have no budget and are met where they stand as whole words.

Null and empty texts hold nothing; items that are null or without a letter or digit are left
out. Repeated rows and items are each reported. Very long texts are searched in stretches that
overlap by more than a segment and its budget; so are very long items, whose parts share OVERLAP characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, materialize
from .arrow import portions

Q, SEGMENT, STRIDE, RATE, SHORTEST = 10, 100, 10, 0.08, 20
#: Characters of a batch of items: its index takes some 40 bytes for each.
BATCH_CHARS, STRETCH = 800_000, 1 << 18
#: A longer item comes in parts of so many characters, which share some with the next.
PART_CHARS, OVERLAP = 100_000, 2_000
_P = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = 42
LEAKS = "item_id long, start int, stop int, edits int"
_lower = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
_PLAIN = np.array([chr(c).isalnum() for c in range(0x3000)])
_LOWER = np.array([_lower(chr(c)) for c in range(0x3000)], np.uint32)


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with separators made single spaces, and where each stands in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes >= 0x3000
    low = np.where(high, 0, codes)
    out, solid = _LOWER[low], _PLAIN[low]
    if high.any():
        kinds, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_lower(chr(c)) for c in kinds], np.uint32)[at]
        solid[high] = np.array([chr(c).isalnum() for c in kinds])[at]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first separator after each run stays, as a space
    at = np.flatnonzero(keep)
    return np.where(solid[at], out[at], np.uint32(32)), at


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    # runs of 1, 2, 4, ... are joined until their lengths add up to q
    run, size, out, done, power = codes.astype(np.uint64), 1, None, 0, _P
    while True:
        if q & size:
            out = run if out is None else out[: len(run) - done] * power + run[done:]
            done += size
        if size * 2 > q:
            break
        run, size, power = run[:-size] * power + run[size:], size * 2, np.uint64(int(power) ** 2 % (1 << 64))
    out = out[: len(codes) - q + 1]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Index(NamedTuple):
    """The items and the places of their q-grams, sorted by hash; exact: short items by length."""

    items: np.ndarray
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    known: np.ndarray
    exact: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[int, str, bool]]) -> Index:
        """items: (id, text, whether the text is the whole item and not a part of a long one)."""
        ids, codes, short = [], [], {}
        for item, text, entire in items:
            whole = normalized(text)[0]
            if not entire and len(whole) < SEGMENT:
                continue  # its segments are in the part before
            if len(whole) and whole[-1] == 32:
                whole = whole[:-1]
            if len(whole) >= SHORTEST:
                ids.append(item)
                codes.append(whole)
            elif len(whole):
                short.setdefault(len(whole), []).append((int(gram_hashes(whole, len(whole))[0]), item))
        length = np.minimum(np.array([len(c) for c in codes], np.int64), SEGMENT)
        budget = np.minimum((length * RATE).astype(np.int64), np.maximum(length // Q - 1, 0))
        hashes = [gram_hashes(c) for c in codes]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        known = np.zeros(1 << 64 - _SHIFT, bool)
        known[(grams >> np.uint64(_SHIFT)).astype(np.int64)] = True
        exact = {n: tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(own), strict=True), (np.uint64, np.int64), strict=True)) for n, own in short.items()}
        return cls(np.array(ids, np.int64), codes, budget, length - Q + 1 - Q * budget, grams, np.append(first, len(flat)), owner[order].astype(np.int32), place[order].astype(np.int32), known, exact)


def banded(pattern: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between the pattern and a stretch of each text (a row, starting anywhere,
    ending anywhere), and where the stretch ends. Row i of the table holds the columns
    i to i + width; cells outside can't be within the budget."""
    rows, wide = len(texts), texts.shape[1] - len(pattern) + 1
    across = np.arange(wide)
    cell = np.zeros((rows, wide), np.int32)
    for i, c in enumerate(pattern):
        best = cell + (texts[:, i : i + wide] != c)
        np.minimum(best[:, :-1], cell[:, 1:] + 1, out=best[:, :-1])
        cell = np.minimum.accumulate(best - across, 1) + across
    end = cell.argmin(1)
    return cell[np.arange(rows), end], end + len(pattern)


def find_leaks(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, stop, edits) of the items in one normalized text, best per item."""
    out: dict[int, tuple[int, int, int]] = {}
    step = STRETCH - 4 * SEGMENT
    for base in range(0, max(1, len(codes)), step):
        part = codes[base : base + STRETCH]
        hashes = gram_hashes(part)
        at = np.flatnonzero(index.known[(hashes >> np.uint64(_SHIFT)).astype(np.int64)])
        for found in (_in_stretch(part, hashes, at, index) if len(at) and len(index.grams) else (), _exact(part, index) if index.exact else ()):
            for item, start, stop, edits in found:
                if item not in out or (edits, start + base) < (out[item][2], out[item][0]):
                    out[item] = (start + base, stop + base, edits)
        if base + STRETCH >= len(codes):
            break
    return [(item, *x) for item, x in sorted(out.items())]


def _exact(codes: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """Short items that stand in the text as whole words."""
    edge = np.concatenate([[True], codes == 32, [True]])  # edge[i]: i - 1 is no part of a word
    for n, (hashes, items) in index.exact.items():
        start = np.flatnonzero(edge[: max(0, len(codes) - n + 1)] & edge[n + 1 :]) if len(codes) >= n else np.zeros(0, np.int64)
        own = gram_hashes(codes, n)[start]
        low, high = (np.searchsorted(hashes, own, side) for side in ("left", "right"))
        for k in np.flatnonzero(high > low).tolist():
            for item in items[low[k] : high[k]].tolist():
                yield item, int(start[k]), int(start[k]) + n, 0


def _in_stretch(codes: np.ndarray, hashes: np.ndarray, at: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    gram = np.searchsorted(index.grams, hashes[at])
    gram[gram == len(index.grams)] = 0
    same = index.grams[gram] == hashes[at]
    at, gram = at[same], gram[same]
    n = index.first[gram + 1] - index.first[gram]
    if not len(n) or n.sum() < index.bound.min():
        return
    spot = np.repeat(at, n)
    entry = np.repeat(index.first[gram], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = index.owner[entry]
    enough = np.bincount(owner, minlength=len(index.bound)) >= index.bound
    if not enough.any():
        return
    left = enough[owner]
    spot, owner, place = spot[left], owner[left].astype(np.int64), index.place[entry[left]].astype(np.int64)
    shift = max(map(len, index.codes))
    band = (spot - place + shift) // (index.budget[owner] + 1)
    # a q-gram of the item counts once in a band, however often it occurs there
    keys, of = np.unique(np.concatenate([owner << 32 | band, owner << 32 | np.maximum(band - 1, 0)]), return_inverse=True)
    hits = np.unique(of << 32 | np.concatenate([place] * 2))
    of, place = hits >> 32, hits & 0xFFFFFFFF
    bound = index.bound[keys >> 32]
    full = np.bincount(of, minlength=len(keys)) >= bound
    of, place = of[full[of]], place[full[of]]
    # the segments of each shared q-gram: starts every STRIDE, the last at the item's end
    size = np.array([len(index.codes[k]) for k in (keys >> 32).tolist()])[of]
    last = np.maximum(size - SEGMENT, 0)
    low = np.minimum(np.maximum(-(-(place - SEGMENT + Q) // STRIDE), 0), -(-last // STRIDE))
    n = np.minimum(place // STRIDE, -(-last // STRIDE)) - low + 1
    segment = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(segment * STRIDE, np.repeat(last, n))
    inside = start <= np.repeat(place, n)
    found, shared = np.unique((np.repeat(of, n) << 32 | start)[inside], return_counts=True)
    found = found[shared >= bound[found >> 32]]
    key, start = keys[found >> 32], found & 0xFFFFFFFF
    for item in np.unique(key >> 32).tolist():
        k, best = int(index.budget[item]), None
        mine = key >> 32 == item
        for a in np.unique(start[mine]).tolist():
            own = index.codes[item][a : a + SEGMENT]
            low = (key[mine & (start == a)] & 0xFFFFFFFF) * (k + 1) - shift + a - k
            edits, stop = _aligned(own, codes, low, k)
            if edits <= k and (best is None or edits < best[0]):
                best = edits, stop, len(own)
            if best and not best[0]:
                break
        if best:
            yield int(index.items[item]), max(0, best[1] - best[2]), best[1], best[0]


def _aligned(own: np.ndarray, codes: np.ndarray, low: np.ndarray, k: int) -> tuple[int, int]:
    """Least edits of a segment in stretches of the text that begin about `low`, and the end there."""
    grid = low[:, None] + np.arange(len(own) + 4 * k + 2)
    inside = (grid >= 0) & (grid < len(codes))
    texts = np.where(inside, codes[np.clip(grid, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
    equal = np.lib.stride_tricks.sliding_window_view(texts, len(own), axis=1)
    row, shift = np.nonzero((equal[:, :, 0] == own[0]) & (equal[:, :, -1] == own[-1]))
    whole = np.flatnonzero((equal[row, shift] == own).all(1))
    if len(whole):
        return 0, int((low[row] + shift)[whole].min()) + len(own)
    edits, end = banded(own, texts)
    best = int(edits.argmin())
    return int(edits[best]), min(len(codes), int(low[best] + end[best]))


def item_parts(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, entire) of the items; one of over PART_CHARS comes as parts that overlap by OVERLAP."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    at = F.sequence(F.lit(1), F.length("text") - OVERLAP, F.lit(PART_CHARS - OVERLAP))
    parts = F.when(F.length("text") <= PART_CHARS, F.array("text")).otherwise(F.transform(at, lambda i: F.substring("text", i, F.lit(PART_CHARS))))
    return items.select("item_id", F.explode(parts).alias("part"), (F.length("text") <= PART_CHARS).alias("entire"))


def item_batches(benchmark: DataFrame, batch_chars: int = BATCH_CHARS) -> Iterator[Index]:
    """The benchmark's indexes, each of about batch_chars characters, however long an item is."""
    items = item_parts(benchmark)
    n = max(1, -(-(items.agg(F.sum(F.length("part"))).first()[0] or 0) // batch_chars))
    for b in range(n):
        yield Index.of([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(n)) == b).collect()])


def _found(texts: list[str | None], index: Index) -> list[list[dict]]:
    out = []
    for t in texts:
        codes, at = normalized(t) if t else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        found = find_leaks(codes, index) if len(codes) else []
        out.append([{"item_id": i, "start": int(at[a]), "stop": int(at[b - 1]) + 1, "edits": e} for i, a, b, e in found])
    return out


def leaks_of(text: Column, index) -> Column:
    """An array of LEAKS for each text; start and stop are offsets in the text itself."""

    @F.pandas_udf(f"array<struct<{LEAKS}>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_found(texts, index.value), dtype=object)

    return run(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "leaks", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """docs with an array of LEAKS in column `name`, which is replaced if it is there.

    A benchmark of one batch takes one pass. Of more, each is a pass of its own that leaves the
    few texts which hold something, by their digests; its index is gone before the next.
    """
    spark, tables = docs.sparkSession, []
    batches = item_batches(benchmark, batch_chars)
    index, following = next(batches), next(batches, None)
    if following is None:
        return docs.withColumn(name, leaks_of(F.col(text), spark.sparkContext.broadcast(index)))
    while index is not None:
        held = spark.sparkContext.broadcast(index)

        def run(rows: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
            for part in (p for batch in rows for p in portions(batch, 1)):
                digests, texts = (c.to_pylist() for c in part.columns)
                got = [(d, x) for d, x in zip(digests, _found(texts, held.value), strict=True) if x]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.string()), pa.array([x for _, x in got], kind)], ["__cf_digest", "__cf_leaks"])

        texts = docs.select(F.md5(text).alias("__cf_digest"), F.col(text).alias("__cf_text")).where("__cf_text is not null")
        tables.append(materialize(texts.mapInArrow(run, f"__cf_digest string, __cf_leaks array<struct<{LEAKS}>>"), "leaks").dropDuplicates(["__cf_digest"]))
        held.destroy()
        index, following = following, next(batches, None)
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    # parts of an item may be in several batches: the best of each item stays
    best = found.select("__cf_digest", F.explode("__cf_leaks").alias("x")).groupBy("__cf_digest", "x.item_id").agg(F.min(F.struct("x.edits", "x.start", "x.stop")).alias("x"))
    found = best.groupBy("__cf_digest").agg(F.array_sort(F.collect_list(F.struct("item_id", "x.start", "x.stop", "x.edits"))).alias("__cf_leaks"))
    column = F.coalesce("__cf_leaks", F.array().cast(f"array<struct<{LEAKS}>>"))
    return docs.join(found, F.md5(text) == F.col("__cf_digest"), "left").withColumn(name, column).drop("__cf_digest", "__cf_leaks")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs that hold no segment of an item; items of fewer than SHORTEST characters, which any text may hold, don't count."""
    out = with_leaks(docs, benchmark, name="__cf_found")
    return out.where(~F.exists("__cf_found", lambda x: x["stop"] - x["start"] >= SHORTEST)).drop("__cf_found")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item of which the document holds a segment."""
    out = with_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
