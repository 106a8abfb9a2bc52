"""Fuzzy line dedup (operator 7).

A line is normalised: A-Z lower-cased, ASCII punctuation and runs of white space made one
space. Equal normalised lines are one class. A class has a 62-bit SimHash of its words (of a
line under SHORT words, of its runs of four bytes) and KEYS keys of a kind: lines of MANY words or
more have keys of three minima over their words, longer words weighing more, lines of MIDDLE words
(both ends in) keys of two such minima, lines of up to NARROW words keys of two minima over their
runs of four bytes; at the borders lines have two kinds. Lines of at most TINY characters are
also keyed by all strings that as many deletions as they may have edits leave, which misses
nothing. Classes that share a key are candidates, without those whose SimHashes differ in more
bits than DISTANCE says, and are linked if the edit similarity of their normalised lines, 1 - edits
/ longer length, is at least 0.8. README says why blocks of the SimHash alone don't do, and has
the recall. Of each connected group of lines over all documents the occurrence with the smallest
(doc_id, line number) stays, the others go.

The rows of a key are compared as they pass, if they are at most FEW; larger buckets go the way of
buckets.py. Edit distances are asked only of pairs that counts of characters don't rule out. Lines without a word always stay. Null texts stay null. Rows with equal doc_id and
text are one document that was written more than once and keep the same lines; a null doc_id
comes after all others. Other columns are kept as they are, but for `lines_gone`, which is
replaced. A line of many megabytes is hashed at once, and confirmed with numbers of as many bits. A table
without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.review import common_places
from . import buckets
from ._spark import documents, materialize, scratch
from .arrow import portions, runs
from .buckets import deal_in_blocks, settle, with_hubs
from .shingles import _P, _P_INVERSE, PORTION, _powers, mix, word_hashes

#: Places in the profile of a line: of characters, of all.
LETTERS, COUNTS = 32, 128
SHORT, NARROW, MIDDLE, MANY, TINY, KEYS, FEW, SPARSE = 10, 5, (4, 11), 9, 14, 8, 12, 16
#: Rows that a task turns into Python objects at a time.
PART = 500
#: Pairs whose edits are counted together, of lines of up to 160 characters; fewer of longer ones.
ALIKE, LONG = 4096, 2500
#: Times buckets.BLOCK that blocks of lines hold.
BLOCKS = 4
#: Levels of length that the rows of a bucket that isn't split are apart at most.
SPREAD = 16
#: Bits in which SimHashes of similar lines differ at most: of words, of runs of bytes.
DISTANCE = (22, 20)
PUNCTUATION = bytes(32 if 33 <= c < 127 and not chr(c).isalnum() else c for c in range(256))
#: Key columns: two keys of 32 bits in each; k of the longest and the shortest lines, g of those between.
PACKED = [f"{x}{i}" for x in "kg" for i in range(KEYS // 2)]
LINES = "_line long, doc_id long, text_hash long, number int, level int, h1 long, h2 long, sim long, " + ", ".join(f"{c} long" for c in PACKED) + ", tiny string"
_KIND = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_ARROW = pa.schema([(x.split()[0], _KIND[x.split()[1]]) for x in LINES.split(", ")])
_RNG = np.random.default_rng(80)
_A = _RNG.integers(0, 1 << 32, 3 * KEYS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, 3 * KEYS, dtype=np.uint32)


class Hashes(NamedTuple):
    """Of lines: words, normalised length, two hashes, SimHash, keys k and g (null by the words, see LINES)."""

    words: np.ndarray
    chars: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    sim: np.ndarray
    k: np.ndarray
    g: np.ndarray

    @classmethod
    def of(cls, lines: list[str]) -> Hashes:
        if len(some := list(runs([len(x) + 50 for x in lines], PORTION))) > 1:
            return cls(*(np.concatenate(x) for x in zip(*(cls.of(lines[k]) for k in some), strict=True)))
        words, bounds, start, end = word_hashes(lines, PUNCTUATION)
        n, a, b = np.diff(bounds), bounds[:-1], bounds[1:]
        hashes = []
        for salt in (0, 0x5851F42D4C957F2D):
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mix(words ^ np.uint64(salt)) * _powers(_P, len(words)), out=sums[1:])
            hashes.append(mix((sums[b] - sums[a]) * _powers(_P_INVERSE, len(words) + 1)[a] + n.astype(np.uint64)).view(np.int64))
        sizes = end - start
        total = np.concatenate([[0], np.cumsum(sizes)])
        # letters and the spaces between words; bytes that go on a letter are all inside words
        chars = total[b] - total[a] + np.maximum(n - 1, 0) - np.array([0 if x.isascii() else len(x.encode("utf-8", "replace")) - len(x) for x in lines])
        sim = simhash(mix(words), a, n, np.where(sizes < 5, 1, 3).astype(np.uint64)) >> np.uint64(2)
        k, g = np.zeros((2, len(lines), KEYS // 2), np.int64)
        if len(full := np.flatnonzero(n)):
            # a longer word's numbers are cut by more, so it gives the minimum more often
            cut = np.clip(2 * np.log2(np.maximum(sizes - 1, 1)), 0, 6).astype(np.uint32)
            minima = least(words, cut, np.cumsum(n[full]) - n[full], 3 * KEYS)
            k[full], g[full] = packed_keys(minima, 3), packed_keys(minima[:, : 2 * KEYS], 2)
        if len(few := np.flatnonzero((n > 0) & (n < SHORT))):
            texts = [b"\n\n" + normalised(lines[i]).encode() + b"\n" for i in few]
            data, size = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), np.array([len(t) for t in texts])
            keep = np.ones(len(data), bool)
            for back in (1, 2, 3):
                keep[np.cumsum(size) - back] = False
            quads = mix((data[:-3] << np.uint64(24) | data[1:-2] << np.uint64(16) | data[2:-1] << np.uint64(8) | data[3:])[keep[:-3]])
            first = np.cumsum(size - 3) - (size - 3)
            sim[few] = simhash(quads, first, size - 3) >> np.uint64(2) | np.uint64(1 << 62)
            narrow = n[few] <= NARROW
            k[few[narrow]] = packed_keys(least(quads, np.uint32(0), first, 2 * KEYS), 2)[narrow]
        return cls(n, chars, *hashes, sim.view(np.int64), k, g)


def least(features: np.ndarray, cut: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """n minima of each run of features, under n hash functions."""
    low = (features >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat((low * _A[k] + _B[k]) >> cut, start) for k in range(n)], 1)


def packed_keys(minima: np.ndarray, each: int) -> np.ndarray:
    """Keys of 32 bits, two in a long, from `each` minima a key."""
    key = np.broadcast_to(np.arange(KEYS, dtype=np.uint64), (len(minima), KEYS))
    for k in range(each):
        key = mix(key * _P + minima[:, k::each])
    return np.ascontiguousarray((key >> np.uint64(32)).astype(np.uint32)).view(np.int64)


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether SimHashes leave room for a link; those of a tiny line, or of two kinds, say nothing."""
    differ = x.view(np.uint64) ^ y.view(np.uint64)
    most = np.where(x >> 62 & 1, DISTANCE[1], DISTANCE[0])
    return (np.bitwise_count(differ) <= most) | (differ >> np.uint64(62) != 0) | (x < 0)


def may_link(x: str, y: str) -> Column:
    """near() of the columns x.sim and y.sim, and lengths that leave room for a link."""
    differ = F.expr(f"{x}.sim ^ {y}.sim")
    levels = F.abs(F.col(f"{x}.level") - F.col(f"{y}.level")) <= 9
    most = F.when(F.shiftright(f"{x}.sim", 62).bitwiseAND(F.lit(1)) == 1, DISTANCE[1]).otherwise(DISTANCE[0])
    return levels & ((F.bit_count(differ) <= most) | (F.shiftrightunsigned(differ, 62) != 0) | (F.col(f"{x}.sim") < 0))


def deletions(line: str) -> set[str]:
    """What is left of a line of at most TINY characters after as many deletions as it may have edits."""
    out = now = {line}
    for _ in range(min(TINY, len(line) * 5 // 4) // 5):
        now = {x[:k] + x[k + 1 :] for x in now for k in range(len(x))}
        out = out | now
    return out


#: Byte -> its bits as counters of 8 bits each, the highest bit first.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def simhash(words: np.ndarray, start: np.ndarray, n: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each line the bits that most of its n features' hashes have, by weight; 0 without any."""
    weights = np.ones(len(words), np.uint64) if weights is None else weights
    sums = np.concatenate([[0], np.cumsum(weights)]).astype(np.int64)
    total = sums[start + n] - sums[start]
    out = np.zeros((len(n), 8), np.uint8)
    short, long = np.flatnonzero((n > 0) & (total < 256)), np.flatnonzero(total >= 256)
    if len(short):
        # every word of all lines, long ones included, is added up; those sums are not used
        full = np.flatnonzero(n)
        keep = total[full] < 256
        for byte in range(8):
            counters = _COUNTERS[(words >> np.uint64(56 - 8 * byte)).astype(np.uint8)] * weights
            votes = np.add.reduceat(counters, start[full])[keep].astype(">u8").view(np.uint8).reshape(-1, 8)
            out[short, byte] = np.packbits(votes.astype(np.uint16) * 2 > total[short][:, None], axis=1).ravel()
    for i in long.tolist():
        own = slice(start[i], start[i] + n[i])
        bits = np.unpackbits(words[own].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[i] = np.packbits(weights[own].astype(np.float64) @ bits * 2 > total[i])
    return out.view(">u8").ravel().astype(np.uint64)


def levels(chars: np.ndarray) -> np.ndarray:
    """8 times the logarithm of the normalised length to the base 1.25: similar lines are at most 8 apart."""
    return np.floor(8 * np.log(np.maximum(chars, 1)) / np.log(1.25)).astype(np.int32)


def line_table(docs: DataFrame) -> DataFrame:
    """LINES of all lines with words, in the shared folder; docs holds doc_id, text, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = TaskContext.get().partitionId() << 43
        for batch in batches:
            for part in portions(batch, 1):
                ids, texts, hashed = part.columns
                split = [(t or "").split("\n") for t in texts.to_pylist()]
                sizes = np.array([len(x) for x in split])
                every = [x for lines in split for x in lines]
                got = Hashes.of(every)
                keep = np.flatnonzero(got.words)
                of = np.repeat(np.arange(len(sizes)), sizes)[keep]
                number = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]
                pick = [x.take(pa.array(of)) for x in (ids, hashed)]
                short = [normalised(every[i]) if got.chars[i] <= TINY else None for i in keep]
                sim = np.where([x is None for x in short], got.sim[keep], np.int64(-1 << 63))
                words, none = got.words[keep], lambda x: pa.array(np.ascontiguousarray(x[0]), mask=x[1])
                keys = [none((c, (words > NARROW) & (words < MANY))) for c in got.k[keep].T] + [none((c, (words < MIDDLE[0]) | (words > MIDDLE[1]))) for c in got.g[keep].T]
                columns = [pa.array(np.arange(line, line + len(keep))), *pick, *map(pa.array, (number.astype(np.int32), levels(got.chars)[keep], got.h1[keep], got.h2[keep], sim)), *keys, pa.array(short, pa.string())]
                line += len(keep)
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text", "text_hash").mapInArrow(run, LINES), "lines")


def normalised(line: str) -> str:
    return b" ".join(line.encode("utf-8", "replace").lower().translate(PUNCTUATION).split()).decode()


def edits(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, with the rows of the table as bits of one number; any larger number once it must exceed `most`."""
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    most = len(b) if most is None else most
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = where.get(c, 0)
        x = ((eq & up) + up ^ up) | eq | down
        plus, minus = down | ~(x | up) & full, up & x
        score += bool(plus & last) - bool(minus & last)
        if score - left > most:
            return score - left
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(x | plus)) & full, plus & x & full
        if left % 64 == 0 and left > 64 and (low := _least_edits(up, down, len(a), len(b) - left, left, most)) > most:
            return low
    return score


def _least_edits(up: int, down: int, m: int, done: int, left: int, most: int) -> int:
    """No fewer edits than the table's end can have by this column, of which every few rows are looked at.

    A path through row i needs the edits there and the difference of what is left of both texts; that changes by two
    a row at most, so a row at half a step from one looked at has at most a step less. Rows more than `most` from the diagonal need more than that.
    """
    step = max(1, most // 8)
    low, high = max(0, done - most), min(m, done + most)
    least = most + step + 1
    for i in [*range(low, high, step), high]:
        mask = (1 << i) - 1
        least = min(least, done + (up & mask).bit_count() - (down & mask).bit_count() + abs(m - i - left))
    return least - step


def gap_edits(x: list[str], y: list[str]) -> int:
    """No fewer edits than two sequences of words need: all letters between words they share in order."""
    out = at_x = at_y = 0
    for i, j in [*common_places(x, y), (len(x), len(y))]:
        out += max(sum(map(len, x[at_x:i])) + i - at_x, sum(map(len, y[at_y:j])) + j - at_y)
        at_x, at_y = i + 1, j + 1
    return out


def similar(a: str, b: str) -> bool:
    """Edit similarity of 0.8 or more."""
    longer = max(len(a), len(b))
    if 5 * abs(len(a) - len(b)) > longer:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and 5 * sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= longer:
        return True  # no more edits than the letters of the words that differ
    return 5 * gap_edits(x, y) <= longer or 5 * edits(a, b, longer // 5) <= longer


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair needs at most `most` edits, no fewer than their lengths differ by: a band of the table as bits, all pairs a column at a time."""
    top = int(most.max())
    words = top // 32 + 1
    band, lead = 64 * words, 64 * words - top - 1
    n, m = (np.array([len(x) for x in side]) for side in (a, b))
    chars = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(chars.max(initial=0)) + 1, bool)
    known[chars] = True
    # numbers from 1, 0 is no character
    code = np.cumsum(known)[chars].astype(np.uint8 if known.sum() < 256 else np.uint32)
    place = lambda sizes: (np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    row, at = place(n)
    rows = np.zeros((len(a), int(m.max()) + band), code.dtype)
    rows[row, at + lead] = code[: len(row)]
    columns = np.zeros((len(a), int(m.max())), code.dtype)
    columns[place(m)] = code[len(row) :]
    one, high = np.uint64(1), np.uint64(63)
    # bit p of a column i is row p + i - lead; the score is followed down the lowest diagonal, then along the last row
    up = np.frombuffer(((1 << band) - (1 << lead)).to_bytes(band // 8, "little"), np.uint64)[:, None].repeat(len(a), 1)
    down, carried = np.zeros_like(up), np.empty_like(up)
    score, own, out = np.minimum(n, top), np.arange(len(a)), np.zeros(len(a), bool)
    for i in range(columns.shape[1]):
        if i % 32 == 0 and i:
            keep = (score <= most + top + m - n) & (i < m)
            done = i >= m
            out[own[done]] = score[done] <= most[done]
            if 4 * keep.sum() < 3 * len(keep):
                own, n, m, most, score = own[keep], n[keep], m[keep], most[keep], score[keep]
                rows, columns, up, down, carried = rows[keep], columns[keep], up[:, keep], down[:, keep], carried[:, keep]
                if not len(own):
                    return out
        eq = np.ascontiguousarray(np.packbits(rows[:, i : i + band] == columns[:, i : i + 1], axis=1, bitorder="little").view("<u8").T)
        part = eq & up
        carry = None
        for w in range(words):
            total = part[w] + up[w]
            more = total < part[w]
            if carry is not None:
                total += carry
                more |= total < carry
            carried[w], carry = total, more.astype(np.uint64)
        diagonal = (carried ^ up) | eq | down
        plus, minus = down | ~(diagonal | up), diagonal & up
        last = i - n + top >= 0
        if not last.any():
            score += (diagonal[-1] >> high == 0)
        else:
            score += ~last & (diagonal[-1] >> high == 0)
            some = np.flatnonzero(last & (i < m))
            bit = band - 2 + n[some] - top - i
            word, bit = bit >> 6, (bit & 63).astype(np.uint64)
            score[some] += (plus[word, some] >> bit & one).astype(np.int64) - (minus[word, some] >> bit & one).astype(np.int64)
        shifted = diagonal >> one
        shifted[:-1] |= diagonal[1:] << high
        up, down = minus | ~(shifted | plus), shifted & plus
    out[own] = score <= most
    return out


def alike(x: list[str], y: list[str]) -> np.ndarray:
    """similar() of many pairs. It is soon done with pairs that share most words, the others are compared together."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    longer = sizes.max(1)
    out = 5 * np.abs(sizes[:, 0] - sizes[:, 1]) <= longer
    unlike = []
    for i in np.flatnonzero(out).tolist():
        p, q = set(x[i].split(" ")), set(y[i].split(" "))
        if longer[i] > LONG or 5 * len(p & q) >= 3 * max(len(p), len(q)):
            out[i] = similar(x[i], y[i])
        else:
            unlike.append(i)
    left = np.array(unlike, np.int64)
    left = left[np.argsort(longer[left], kind="stable")]
    words = longer[left] // 160 + 1
    for w in np.unique(words).tolist():
        some = left[words == w]
        for k in range(0, len(some), max(1, ALIKE // w)):
            part = some[k : k + max(1, ALIKE // w)]
            if len(part) < 2 * FEW:
                out[part] = [similar(x[i], y[i]) for i in part]
            else:
                out[part] = within([x[i] for i in part], [y[i] for i in part], longer[part] // 5)
    return out


def profiles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of lines: counts of characters (LETTERS places) and of pairs of neighbouring ones (COUNTS - LETTERS), up to 255; lengths."""
    sizes = np.array([len(x) for x in lines], np.int64)
    out = np.zeros((len(lines), COUNTS), np.uint8)
    for part in runs((sizes + 50).tolist(), 1 << 18):
        n = sizes[part]
        chars = np.frombuffer("".join(lines[part]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            continue
        row = np.repeat(np.arange(len(n)) * COUNTS, n)
        inside = row[1:] == row[:-1]
        two = (chars[:-1] * np.uint32(37) + chars[1:])[inside] % np.uint32(COUNTS - LETTERS)
        places = np.concatenate([row + chars % np.uint32(LETTERS), row[1:][inside] + LETTERS + two])
        out[part] = np.minimum(np.bincount(places, minlength=len(n) * COUNTS), 255).reshape(-1, COUNTS)
    return out, sizes


def may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only for pairs that similar() denies, by profiles x and y and lengths n and m.

    An edit adds at most one character and two pairs of neighbours, and takes away as many; counts in the
    same place, and those cut at 255, only bring profiles nearer.
    """
    longer = np.maximum(n, m)
    ok = 5 * np.abs(n - m) <= longer
    for at in range(0, len(x), 1 << 14):
        part = slice(at, at + (1 << 14))
        differ = x[part].astype(np.int16) - y[part]
        for own, each in ((differ[:, :LETTERS], 1), (differ[:, LETTERS:], 2)):
            most = (np.abs(own).sum(1, dtype=np.int64) + np.abs(own.sum(1, dtype=np.int64))) // 2
            ok[part] &= 5 * most <= each * longer[part]
    return ok


#: Bits of a filter on documents; its size doesn't depend on how many there are.
FILTER_BITS = 1 << 24


def _marked(df: DataFrame, keys: DataFrame, text_hash: str = "text_hash") -> DataFrame:
    """df with __cf_may: false only where keys don't hold its (doc_id, text_hash).

    The pairs' hashes set bits of a map of FILTER_BITS, which goes to the tasks as at most FILTER_BITS / 64
    rows; so texts that no join will use aren't shuffled. A full map lets all pass, with the same result.
    """
    place = lambda hashed: F.xxhash64("doc_id", hashed).bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = lambda hashed: F.call_function("shiftleft", F.lit(1).cast("long"), place(hashed).bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(place("text_hash"), 6).alias("__cf_word")).agg(F.bit_or(bit("text_hash")).alias("__cf_bits"))
    out = df.withColumn("__cf_word", F.shiftright(place(text_hash), 6)).join(F.broadcast(words), "__cf_word", "left")
    may = F.coalesce("__cf_bits", F.lit(0).cast("long")).bitwiseAND(bit(text_hash)) != 0
    return out.withColumn("__cf_may", may).drop("__cf_word", "__cf_bits")


def _texts(nodes: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, line, level, sim, PACKED) of the lines numbered in column node, normalised; of a kind of key that a line lacks it has numbers of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                texts = [t.split("\n") for t in part.column(0).to_pylist()]
                of, at = np.repeat(np.arange(len(texts)), pc.list_value_length(part.column(1)).to_numpy()), part.column(1).flatten()
                own = [normalised(texts[i][k]) for i, k in zip(of.tolist(), at.field("number").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([at.field("node"), pa.array(own, pa.string()), *(at.field(c) for c in kept)], ["node", "line", *kept])

    kept = ["level", "sim", *PACKED]
    wanted = lines.join(nodes.select(F.col("node").alias("_line")).distinct(), "_line", "left_semi")
    known = [F.coalesce(c, F.xxhash64("_line", F.lit(c))).alias(c) for c in PACKED]
    wanted = wanted.groupBy(F.col("doc_id").alias("__cf_id"), F.col("text_hash").alias("__cf_hash")).agg(F.collect_list(F.struct("number", F.col("_line").alias("node"), "level", "sim", *known)).alias("at"))
    wanted = materialize(wanted, "wanted")
    marked = _marked(docs, wanted.select(F.col("__cf_id").alias("doc_id"), F.col("__cf_hash").alias("text_hash")))
    held = marked.where("__cf_may").join(wanted, F.col("doc_id").eqNullSafe(F.col("__cf_id")) & (F.col("text_hash") == F.col("__cf_hash")))
    held = held.select("text", "at").mapInArrow(run, "node long, line string, level int, sim long, " + ", ".join(f"{c} long" for c in PACKED))
    # several rows can be one document
    return materialize(held.dropDuplicates(["node"]), "line-texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, bounded: bool = False) -> DataFrame:
    """Links (u, v): the similar ones of pairs (a, b); bounded: only those that may_link() allows."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_pylist()
            for some in runs(sizes, 4 << 20):
                part = batch.slice(some.start, some.stop - some.start)
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                (p, n), (q, m) = profiles(x), profiles(y)
                good = may_be_similar(p, q, n, m)
                left = np.flatnonzero(good)
                good[left] = alike([x[i] for i in left], [y[i] for i in left])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    columns = ["line", "level", "sim"] if bounded else ["line"]
    left, right = (texts.select(F.col("node").alias(x), F.struct(*columns).alias(f"of_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(may_link("of_a", "of_b")) if bounded else both
    return both.select("a", "b", F.col("of_a.line").alias("line_a"), F.col("of_b.line").alias("line_b")).mapInArrow(test, "u long, v long")


def _links_in_blocks(rest: DataFrame, info: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join the components of mixed buckets (key, node, component).

    info may hold the lines too. A task takes the blocks one after another, many small ones at a time. Pairs that SimHashes and profiles
    leave come out and are confirmed once, however many buckets they share. Where these are
    many for the block's rows, the task confirms only what still joins components.
    """
    names = ["key", "i", "j", "side", "component", "node", "sim", "level", *PACKED, "line"]

    def near_pairs(key, side, component, sim, level, packed, lines, at) -> np.ndarray:
        """Pairs of rows that may be linked; at: where blocks begin."""
        of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(key)]))
        sided = np.maximum.reduceat(side, at)[of] > 0
        again = level // 8 < key & 255  # such rows share the part of shorter lines too
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, len(key)):
            i = np.flatnonzero(of[d:] == of[:-d])
            if not len(i):
                break
            j = i + d
            ok = (component[i] != component[j]) & ~(sided[i] & (side[i] == side[j])) & ~(again[i] & again[j])
            i, j = i[ok], j[ok]
            ok = near(sim[i], sim[j])
            found.append(np.stack([i[ok], j[ok]], 1))
        i, j = np.concatenate(found).T
        # rows that share an earlier key too have met there
        for k in range(2 * KEYS):
            half = packed[k // 2] >> 32 * (k % 2) & 0xFFFFFFFF
            ok = (half[i] != half[j]) | (key[i] >> 40 <= k)
            i, j = i[ok], j[ok]
        profile, size = profiles(lines)
        ok = np.concatenate([np.zeros(0, bool), *(may_be_similar(profile[p], profile[q], size[p], size[q]) for p, q in ((i[k : k + PART * 100], j[k : k + PART * 100]) for k in range(0, len(i), PART * 100)))])
        return np.stack([i[ok], j[ok]], 1)

    def confirmed(pairs: np.ndarray, component: np.ndarray, lines: list[str]) -> np.ndarray:
        root = {c: c for c in component[pairs].ravel().tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = np.zeros(len(pairs), bool)
        for at in range(0, len(pairs), ALIKE):
            some = [(k, i, j) for k, (i, j) in enumerate(pairs[at : at + ALIKE].tolist(), at) if find(int(component[i])) != find(int(component[j]))]
            good = alike([lines[i] for _, i, _ in some], [lines[j] for *_, j in some])
            for (k, i, j), ok in zip(some, good.tolist(), strict=True):
                p, q = find(int(component[i])), find(int(component[j]))
                if ok and p != q:
                    root[p], out[k] = q, True
        return out

    def of_blocks(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of rows whose blocks are complete."""
        key, i, j = (rows.column(k).to_numpy() for k in range(3))
        at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for some in runs(np.diff(np.r_[at, len(key)]).tolist(), 2 * BLOCKS * buckets.BLOCK):
            a, b = at[some.start], at[some.stop] if some.stop < len(at) else len(key)
            part = rows.slice(a, b - a)
            own, side, component, node, sim, level, *packed = (part.column(k).to_numpy() for k in (0, *range(3, len(names) - 1)))
            lines, first = part.column(len(names) - 1).to_pylist(), at[some] - a
            pairs = near_pairs(own, side, component, sim, level, packed, lines, first)
            block = np.searchsorted(first, pairs[:, 0], "right") - 1
            many = np.bincount(block, minlength=len(first)) > SPARSE * np.diff(np.r_[first, len(own)])
            keep, sure = np.ones(len(pairs), bool), many[block]
            for k in np.flatnonzero(many).tolist():
                keep[block == k] = confirmed(pairs[block == k], component, lines)
            ends = np.sort(node[pairs], axis=1)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(sure[keep])], ["u", "v", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pa.concat_batches([kept, batch])
            if not rows.num_rows:
                continue
            differ = np.zeros(rows.num_rows, bool)
            for k in range(3):
                column = rows.column(k).to_numpy()
                differ |= column != column[-1]
            end = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
            kept = rows.slice(end)
            if end:
                yield from of_blocks(rows.slice(0, end))
        if kept is not None:
            yield from of_blocks(kept)

    rows = rest.join(info, "node")
    dealt = deal_in_blocks(rows if "line" in info.columns else rows.join(texts, "node"), BLOCKS).withColumns({c: F.col(c).cast("long") for c in ("i", "j", "side", "level")})
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*names).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(dealt.mapInArrow(run, "u long, v long, sure boolean"), "near")
    maybe = found.where("not sure").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    return materialize(found.where("sure").select("u", "v").unionByName(_confirmed(maybe, texts)), "links")


def deletion_keys(tiny: DataFrame) -> DataFrame:
    """(key, node, sim) of lines (node, tiny, sim): what deletions leave, in hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, PART) for b in batches for k in range(0, b.num_rows, PART)):
            made = [(h, i, s) for i, x, s in zip(*(c.to_pylist() for c in part.columns), strict=True) for h in {1 << 62 | int.from_bytes(blake2b(y.encode(), digest_size=8).digest()) >> 12 << 10 for y in deletions(x)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [[]] * 3)], ["key", "node", "sim"])

    return tiny.select("node", "tiny", "sim").mapInArrow(run, "key long, node long, sim long")


def shared_keys(slim: DataFrame, more: DataFrame) -> DataFrame:
    """(key, a, b): what the nodes that share a key give. more: further rows (key, node, sim).

    Rows of a key come one after another. Of up to FEW rows, all pairs a, b within the
    distance come out, with a null key; of more rows, each row with its key and level of
    length, node and SimHash. So a task holds FEW rows of a key at most, and chance collisions give nothing.
    """
    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        """Of rows whose keys are complete and have FEW rows at most."""
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, FEW):
            same = np.flatnonzero(rows[d:, 0] >> 10 == rows[:-d, 0] >> 10) if len(rows) > d else []
            if not len(same):
                break
            x, y = rows[same], rows[same + d]
            ok = (y[:, 0] - x[:, 0] <= 9) & near(x[:, 2].copy(), y[:, 2].copy())
            found.append(np.stack([np.minimum(x[ok, 1], y[ok, 1]), np.maximum(x[ok, 1], y[ok, 1])], 1))
        out = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.array(out[:, 0]), pa.array(out[:, 1])], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, large = np.zeros((0, 3), np.int64), None  # the last key's rows so far; the last key if it has more than FEW
        for batch in batches:
            rows = np.concatenate([kept, np.stack([c.to_numpy() for c in batch.columns], 1)])
            if not len(rows):
                continue
            first = np.flatnonzero(np.r_[True, rows[1:, 0] >> 10 != rows[:-1, 0] >> 10])
            size = np.diff(np.r_[first, len(rows)])
            many = size > FEW
            if large is not None and rows[0, 0] >> 10 == large:
                many[0] = True
            big = np.repeat(many, size)
            if big.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[big, k]) for k in range(3)], ["key", "a", "b"])
            large = rows[-1, 0] >> 10 if many[-1] else None
            last = np.arange(len(rows)) >= first[-1]
            kept = rows[last & ~big]
            yield pairs(rows[~last & ~big])
        yield pairs(kept)

    # a key has its number above its 32 bits, the level of length below them
    keys = []
    for k in range(2 * KEYS):
        half = F.col(PACKED[k // 2]) if k % 2 == 0 else F.shiftright(PACKED[k // 2], 32)
        keys.append(F.shiftleft(half.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(k << 32)), 10).bitwiseOR(F.col("level").cast("long")))
    rows = slim.select(F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("key"), "node", "sim").unionByName(more)
    rows = rows.repartition(F.shiftright("key", 10)).sortWithinPartitions("key")
    return rows.mapInArrow(run, "key long, a long, b long")


def by_length(large: DataFrame) -> DataFrame:
    """(key, node): the parts of large buckets (key, node, with the level of length in the key) in which rows of like length meet.

    A bucket whose levels are at most SPREAD apart is one part. Else two rows of one level of eight or of
    neighbouring ones meet, and each row is in two parts.
    """
    rows = large.select(F.shiftright("key", 10).alias("base"), F.col("key").bitwiseAND(F.lit(1023)).alias("level"), "node")
    spread = rows.groupBy("base").agg((F.max("level") - F.min("level")).alias("spread"))
    part = F.shiftright("level", 3)
    parts = F.when(F.col("spread") <= SPREAD, F.array(F.lit(0).cast("long"))).otherwise(F.array(part, part + 1))
    return rows.join(spread, "base").select("base", "node", F.explode(parts).alias("part")).select((F.shiftleft("base", 8) + F.col("part")).alias("key"), "node")


def line_groups(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(h1, h2, group) of the classes that occur more than once or are linked."""
    with scratch(docs.sparkSession):
        classes = lines.groupBy("h1", "h2").agg(F.min("_line").alias("node"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("level", "sim", *PACKED)])
        classes = materialize(classes, "line-classes")
        tiny = lines.where("tiny is not null").groupBy("h1", "h2").agg(F.min("_line").alias("node"), F.first("sim").alias("sim"), F.first("tiny").alias("tiny"))
        shared = materialize(shared_keys(classes, deletion_keys(tiny)), "buckets")
        first = materialize(shared.where("key is null").select("a", "b").distinct(), "pairs")
        large = materialize(by_length(shared.where("key is not null").select("key", F.col("a").alias("node"))), "large")
        texts = _texts(first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")), lines, docs)

        def test(pairs: DataFrame) -> DataFrame:
            return materialize(_confirmed(pairs, texts, bounded=True), "links")

        links = materialize(_confirmed(first, texts), "links")
        groups = settle(with_hubs(large), links, test, lambda rest: _links_in_blocks(rest, texts, texts), 1)
        out = classes.join(groups, "node", "left").where("times > 1 or component is not null")
        return materialize(out.select("h1", "h2", F.coalesce("component", "node").alias("group")), "line-groups", keep=True)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, numbers): the lines that go; docs holds doc_id, text, text_hash."""
    with scratch(docs.sparkSession):
        lines = line_table(docs)
        found = lines.join(line_groups(lines, docs), ["h1", "h2"]).select("group", F.col("doc_id").isNull().alias("late"), "doc_id", "number", "text_hash")
        found = materialize(found, "found")
        kept = found.groupBy("group").agg(F.min(F.struct("late", "doc_id", "number", "text_hash")).alias("x")).select("x.*")
        # by place and not by group, a key that holds no more than a document's copies
        kept = kept.select(F.col("doc_id").alias("_id"), F.col("number").alias("_number"), F.col("text_hash").alias("_hash"))
        gone = found.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("number") == F.col("_number")) & (F.col("text_hash") == F.col("_hash")), "left_anti")
        return materialize(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("numbers")), "dropped", keep=True)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    out = []
    for t, gone in zip(texts, numbers, strict=True):
        gone = set() if gone is None else set(gone.tolist())
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that go, and the number of lines that went in `lines_gone`."""
    own = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "__cf_text_hash": F.xxhash64("text")})
    gone = dropped_lines(own.select("doc_id", "text", F.col("__cf_text_hash").alias("text_hash")))
    marked = _marked(own, gone, "__cf_text_hash")
    found = gone.select(F.col("doc_id").alias("__cf_id"), F.col("text_hash").alias("__cf_hash"), F.col("numbers").alias("__cf_gone"))
    out = marked.where("__cf_may").drop("__cf_may").join(found, F.col("doc_id").eqNullSafe(F.col("__cf_id")) & (F.col("__cf_text_hash") == F.col("__cf_hash")), "left")
    # only texts that lose lines go through Python
    less = _without(F.when(F.col("__cf_gone").isNotNull(), F.col("text")), F.col("__cf_gone"))
    out = out.withColumns({"text": F.when(F.col("__cf_gone").isNotNull(), less).otherwise(F.col("text")), "lines_gone": F.coalesce(F.size("__cf_gone"), F.lit(0))})
    out = out.drop("__cf_id", "__cf_hash", "__cf_gone").unionByName(marked.where("not __cf_may").drop("__cf_may").withColumn("lines_gone", F.lit(0)))
    return out.drop("__cf_text_hash")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document how many lines went, and checksum and length of the text that is left."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "lines_gone", F.crc32("text").alias("text_crc32"), F.length("text").alias("n_chars"))
