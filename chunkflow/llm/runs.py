"""Periodic runs of words (operator 12).

Words are what ASCII white space leaves. A run is a stretch of words with smallest period q (words
q apart are identical) of at least LEAST words and TIMES periods, which no word next to it extends.

Texts are put after one another, a portion at a time. Suffixes of a text that share their first
words are ranked by doubling, and only those that still share are ranked on. Neighbours in that order
have an LCP, from the ranks of every length. By decreasing LCP the classes of suffixes are united
(Kruskal): a class is the ordered set of its positions, the smaller goes into the larger. Two
positions that become adjacent by a union have just that LCP. A run of period q that begins at s is
met exactly once: s and s + q become adjacent at the LCP of the run's length less q. Of adjacent
positions at a distance within the LCP those are kept that the words before don't extend to the left.

Null and empty texts have no words and no runs. Repeated rows are worked on each. A very long
text is one portion: ranks take four bytes a word for every length that is still shared. Other
columns are kept, but for those of FOUND, which are replaced. A table without rows gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ._spark import documents
from .arrow import portions
from .pieces import starts

LEAST, TIMES = 6, 4
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all in order; null texts have none."""
    made = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, of = made.flatten(), np.repeat(np.arange(len(made)), pc.list_value_length(made).to_numpy())
    there = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    return np.bincount(of[there.to_numpy(zero_copy_only=False)], minlength=len(made)), words.filter(there)


class Suffixes:
    """Suffixes of the texts in codes that share `first` words or more with another of their text.

    codes: a number over 0 for each word, and a 0 after each text; of: the text of each.
    """

    def __init__(self, codes: np.ndarray, of: np.ndarray, first: int):
        n, width = len(codes), int(codes.max(initial=0)) + 1
        self.codes, self.first = codes, first
        key, held = of.astype(np.int64), int(of.max(initial=0)) + 1
        ahead = np.concatenate([codes, np.zeros(first, codes.dtype)])
        for k in range(first):
            if held > (1 << 62) // width:  # words so far as one number of few digits
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                held = int(key.max(initial=0)) + 1
            key, held = key * width + ahead[k : k + n], held * width
        # texts end in a 0 at a place of its own, so a shared key never reaches over an end
        order = np.argsort(key, kind="stable")
        rank, shared = self._ranks(key[order])
        self.rank = np.empty(n, np.int32)
        self.rank[order] = rank
        self.levels: list[tuple[int, np.ndarray]] = []
        self.active = active = order[shared]
        h = first
        while len(active):
            self.levels.append((h, self.rank.copy()))
            base, key = self.rank[active], self.rank[active].astype(np.int64) * (n + 1) + self.rank[active + h]
            order = np.argsort(key, kind="stable")
            active, base = active[order], base[order]
            begins = np.flatnonzero(np.diff(base, prepend=-1))  # groups of the shorter length
            rank, shared = self._ranks(key[order])
            at = np.repeat(begins, np.diff(np.append(begins, len(base))))
            self.rank[active] = base + (rank - at)
            active, h = active[shared], 2 * h

    @staticmethod
    def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys the place where each one's equals begin, and whether it has any."""
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])[: len(key) + 1] if len(key) else np.array([True])
        rank = np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
        return rank, ~(new[:-1] & new[1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j share."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for h, rank in reversed(self.levels):
            step = np.where(rank[i] == rank[j], h, 0)
            for x in (i, j, out):
                x += step
        going = np.ones(len(i), bool)
        for _ in range(self.first - 1):
            going &= (self.codes[i] == self.codes[j]) & (self.codes[i] > 0)
            for x in (i, j, out):
                x += going
        return out

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that follow one another in the order of suffixes, with their LCP."""
        order = self.active[np.argsort(self.rank[self.active], kind="stable")]
        return order[:-1], order[1:], self.common(order[:-1], order[1:])


def new_neighbours(i: np.ndarray, j: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite the classes of i and j by decreasing LCP: pairs of positions that become adjacent, with the LCP."""
    at = np.unique(np.concatenate([i, j]))
    order = np.argsort(-lcp, kind="stable")
    a, b = (np.searchsorted(at, x[order]).tolist() for x in (i, j))
    root = list(range(len(at)))
    members: list[list[int] | None] = [None] * len(at)
    low, high, shared = [], [], []
    for x, y, common in zip(a, b, lcp[order].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        large, small = members[x] or [x], members[y] or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        if len(small) == 1:
            p = small[0]
            k = bisect_left(large, p)
            if k:
                low.append(large[k - 1])
                high.append(p)
                shared.append(common)
            if k < len(large):
                low.append(p)
                high.append(large[k])
                shared.append(common)
            large.insert(k, p)
        else:
            for p in small:
                large.insert(bisect_left(large, p), p)
            added = set(small)
            for p in small:
                k = bisect_left(large, p)
                if k and large[k - 1] not in added:
                    low.append(large[k - 1])
                    high.append(p)
                    shared.append(common)
                if k + 1 < len(large) and large[k + 1] not in added:
                    low.append(p)
                    high.append(large[k + 1])
                    shared.append(common)
        root[y], members[x], members[y] = x, large, None
    return at[low].astype(np.int64), at[high].astype(np.int64), np.array(shared, np.int64)


def periodic_runs(codes: np.ndarray, of: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in codes, by start, then period; see Suffixes."""
    # two occurrences one period apart share the run's length less a period
    fewest = max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))
    i, j, lcp = Suffixes(codes, of, fewest).neighbours()
    enough = lcp >= fewest
    low, high, lcp = new_neighbours(i[enough], j[enough], lcp[enough])
    period = high - low
    before = (low == 0) | (codes[low - 1] != codes[high - 1]) | (codes[low - 1] == 0)
    runs = (lcp + period >= np.maximum(least, times * period)) & before
    start, length, period = low[runs], (lcp + period)[runs], period[runs]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with FOUND: each text's words, its runs in order, and the text without what repeats in them.

    A word goes if a run holds it after that run's first period; the others are joined by spaces.
    """
    if times < 2:
        raise ValueError("a run has its period twice at least")
    fields = StructType.fromDDL(FOUND).fields
    kept = [c for c in docs.columns if c not in {f.name for f in fields}]
    schema = StructType([*(docs.schema[c] for c in kept), *fields])
    arrow, at = to_arrow_schema(schema), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in portions(b, at)):
            sizes, words = split_words(part.column(at))
            n, ends = len(sizes), starts(sizes)
            of = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
            is_word = np.ones(len(of), bool)
            is_word[ends[1:] + np.arange(n)] = False
            codes = np.zeros(len(of), np.int32)
            codes[is_word] = words.dictionary_encode().indices.to_numpy() + 1
            start, length, period = periodic_runs(codes, of, least, times)
            # words inside a run, after its first period
            open_ = np.zeros(len(of) + 1, np.int64)
            np.add.at(open_, start + period, 1)
            np.add.at(open_, start + length, -1)
            stays = (np.cumsum(open_[:-1]) == 0) & is_word
            left = starts(np.bincount(of[stays], minlength=n))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stays[is_word]))), " ")
            own = of[start]
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - ends[own] - own, length, period)], ["start", "length", "period"])
            found = pa.ListArray.from_arrays(pa.array(starts(np.bincount(own, minlength=n)), pa.int32()), rows)
            new = [pa.array(sizes, pa.int64()), found.cast(arrow.field(len(kept) + 1).type), collapsed]
            yield pa.RecordBatch.from_arrays([*(part.column(k).cast(arrow.field(k).type) for k in range(len(kept))), *new], schema=arrow)

    return docs.select(*kept).mapInArrow(run, schema)


def greatest(runs: Column) -> Column:
    """The run of the greatest length by period, the first of several; null without any."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of the query: every tenth document by its number's CRC-32 repeats from some word on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in portions(b, 1)):
            texts = part.column(1)
            marks = [zlib.crc32(str(d).encode()) for d in part.column(0).to_pylist()]
            chosen = [k for k, h in enumerate(marks) if h % 10 == 0]
            sizes, words = split_words(texts.take(pa.array(chosen, pa.int64())))
            ends, places, counts = starts(sizes), [], []
            for k, c in enumerate(chosen):
                n, g = int(sizes[k]), marks[c] // 10
                place = np.arange(n)
                if n:
                    a = g % n
                    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
                places.append(ends[k] + place)
                counts.append(n)
            flat = words.take(pa.array(np.concatenate([np.zeros(0, np.int64), *places])))
            changed = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), flat), " ")
            at = np.arange(len(texts))
            at[chosen] = len(texts) + np.arange(len(chosen))
            both = pa.concat_arrays([texts, changed.cast(texts.type)])
            yield pa.RecordBatch.from_arrays([part.column(0), both.take(pa.array(at))], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], StructField("text", StringType())]))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(documents(spark, sf_dir))).drop("text")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("_best", greatest(F.col("runs")))
    milli = F.expr("(1000 * _best.length) div _best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        milli.alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
